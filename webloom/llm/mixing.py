"""Drawing documents so that each source supplies its share of all tokens.

Tokens are summed by source, language and topic (doc_kind). Iterative proportional fitting
rakes these cells to the shares of the sources and, as far as the repeat caps leave room, to
the languages and topics of the collection. Each cell then has an expected number of repeats
per document, and documents get whole numbers of repeats along a hashed order in which the
rounding error is carried on, group by group, so that no group is off by more than about
half a document.

The total is the largest one at which every source that has documents can meet its share
within its cap, unless a total is asked for; then a source that falls short supplies all it
may and the others make up for it in proportion. Sources are compared without case, outer
blanks and underscores. Documents without source, of a source without target, or without
tokens are not drawn. A source that is listed twice keeps its first row by share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import LANGUAGE_OF_NAME
from webloom.session import cut

ITERATIONS = 60
#: Documents per task in the rounding.
GROUP = 20_000
#: Cells come to the driver; sources are those of the targets, languages and topics few.
MAX_CELLS = 200_000


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[_\\s]+", "-")


def language_key(c: Column) -> Column:
    """Two-letter language of a label, "und" where it names none."""
    head = F.regexp_extract(F.lower(F.trim(c)), r"^[^-_ (/;,.]+", 0)
    table = F.create_map(*[F.lit(x) for pair in sorted(LANGUAGE_OF_NAME.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, head), F.lit("und"))


def rake(available: np.ndarray, caps: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = ITERATIONS) -> np.ndarray:
    """Cell weights whose sums follow the margins, none above its cap.

    margins: (group of each cell, target of each group); the last one is met exactly where
    its caps allow it.
    """
    weight = np.minimum(available.astype(float), caps)
    for _ in range(rounds):
        for group, target in margins:
            for _ in range(8):
                sums = np.bincount(group, weights=weight, minlength=len(target))
                fixed = np.bincount(group, weights=np.where(weight >= caps * (1 - 1e-12), weight, 0), minlength=len(target))
                loose = sums - fixed
                factor = np.where(loose > 0, np.maximum(target - fixed, 0) / np.maximum(loose, 1e-300), 1.0)
                down = sums > target
                factor = np.where(down, target / np.maximum(sums, 1e-300), factor)
                new = np.where((weight >= caps * (1 - 1e-12)) & ~down[group], weight, weight * factor[group])
                new = np.minimum(new, caps)
                if np.allclose(new, weight, rtol=1e-10, atol=1e-9):
                    break
                weight = new
    return weight


def _rounded(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    doc = table.column("doc_id").to_numpy()[order]
    tokens = table.column("tokens").to_numpy()[order].astype(float)
    expected = table.column("expected").to_numpy()[order]
    most = table.column("max_repeats").to_numpy()[order]
    repeats = np.zeros(len(doc), dtype=np.int32)
    carry = 0.0
    for i in range(len(doc)):
        want = expected[i] * tokens[i] + carry
        k = int(min(most[i], max(np.floor(expected[i]), min(np.ceil(expected[i]), np.floor(want / tokens[i] + 0.5)))))
        repeats[i] = k
        carry = want - k * tokens[i]
    kept = repeats > 0
    names = table.column("source").to_numpy(zero_copy_only=False)[order]
    return pa.table({"doc_id": pa.array(doc[kept], pa.int64()), "source": pa.array(names[kept], pa.string()), "tokens": pa.array(tokens[kept].astype(np.int64)), "repeats": pa.array(repeats[kept])})


def plan(cells: list, targets: list, total: float | None = None) -> list[tuple]:
    """(source, language, topic, expected repeats) of each cell. cells: source, language, topic, tokens."""
    caps = {t["source"]: max(0, int(t["max_repeats"] or 0)) for t in targets}
    share = {t["source"]: max(0.0, float(t["target_share"] or 0)) for t in targets}
    cells = [c for c in cells if share.get(c[0], 0) > 0 and caps[c[0]] > 0 and c[3] > 0]
    if not cells:
        return []
    sources = sorted({c[0] for c in cells})
    have = {s: sum(c[3] for c in cells if c[0] == s) for s in sources}
    live = sum(share[s] for s in sources)
    most = {s: caps[s] * have[s] for s in sources}
    if total is None:
        total = min(most[s] * live / share[s] for s in sources)
    goal, rest = {}, set(sources)
    left = float(total)
    while rest:
        weight = sum(share[s] for s in rest)
        short = {s for s in rest if left * share[s] / weight > most[s] + 1e-9}
        if not short:
            goal |= {s: left * share[s] / weight for s in rest}
            break
        for s in short:
            goal[s] = most[s]
            left -= most[s]
        rest -= short
    available = np.array([c[3] for c in cells], dtype=float)
    limits = np.array([c[3] * caps[c[0]] for c in cells], dtype=float)
    drawn = sum(goal.values())
    margins = []
    for part in (2, 1):
        names = sorted({c[part] for c in cells})
        group = np.array([names.index(c[part]) for c in cells])
        margins.append((group, np.bincount(group, weights=available) / available.sum() * drawn))
    group = np.array([sources.index(c[0]) for c in cells])
    margins.append((group, np.array([goal[s] for s in sources])))
    weight = rake(available, limits, margins)
    return [(c[0], c[1], c[2], float(w / c[3])) for c, w in zip(cells, weight)]


def mixture(documents: DataFrame, sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """doc_id, source, tokens and repeats of the documents that are drawn."""
    wanted = [r.asDict() for r in targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").orderBy("source", F.desc("target_share")).collect()]
    wanted = list({t["source"]: t for t in reversed(wanted)}.values())
    spark = documents.sparkSession
    known = spark.createDataFrame([(t["source"], int(t["max_repeats"] or 0)) for t in wanted], "source string, max_repeats int")
    labelled = documents.select(
        "doc_id", source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("language"), F.coalesce("doc_kind", F.lit("")).alias("topic")
    ).join(F.broadcast(known), "source")
    rows = cut(labelled.join(sizes.where("tokens > 0"), "doc_id"))
    cells = rows.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError("too many topics for cells on the driver")
    expected = spark.createDataFrame(plan([tuple(c)[:4] for c in cells], wanted, total), "source string, language string, topic string, expected double")
    documents_of: dict[str, int] = {}
    for c in cells:
        documents_of[c.source] = documents_of.get(c.source, 0) + c.documents
    tasks = spark.createDataFrame([(s, -(-n // GROUP)) for s, n in documents_of.items()], "source string, tasks int")
    dealt = rows.join(F.broadcast(expected), ["source", "language", "topic"]).join(F.broadcast(tasks), "source")
    dealt = dealt.withColumn("place", F.xxhash64("doc_id", F.lit(17))).withColumn("task", F.pmod(F.xxhash64("doc_id"), F.col("tasks")))
    return dealt.select("source", "task", "doc_id", "tokens", "expected", "max_repeats", "place").groupBy("source", "task").applyInArrow(_rounded, "doc_id long, source string, tokens long, repeats int")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and actual share, tokens and documents drawn, the most repeats used."""
    sums = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    total = sums.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    return (
        wanted.join(sums, "source", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        )
    )


__all__ = ["mixture", "plan", "rake", "shares"]
