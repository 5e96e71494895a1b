"""Facts of crawled pages in one reading: spam features, residue evidence, and who is left out.

Empty tables and pages give empty results. A null text counts as an empty page, a null
title as none, a null url as the site "". Rows stored twice are judged twice, alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import residue, trees
from webloom.llm.features import FEATURES, Residuals
from webloom.llm.frames import FrameReader, Wrappers, extra, learn, site_of
from webloom.llm.sizes import chunks
from webloom.session import cut

#: Labelled pages per class on which the trees are fitted.
TRAINING_PAGES = 4_000
#: Weight of a host's spam rate against the page's own evidence.
HOST_WEIGHT = 0.25
SPAM_CUT = 0.5
NOTICE_SHARE = 0.5
#: Rows of a batch that is read at once; bounds a Python worker's memory.
FACT_SCHEMA = "page_id long, host_key long, features array<float>, weak int, placeholders int, notice_share float, has_text boolean, content double, bare array<struct<key:long,chars:double>>"
LANGUAGE_FIELD = "languages array<struct<line_no:int,lang:string,confidence:double,named:string>>"


def crawled(df: DataFrame) -> DataFrame:
    """The columns that are read, by their names in crawled_pages."""
    return df.select(
        "page_id",
        F.col("page_id").alias("record_id"),
        F.xxhash64(F.coalesce(site_of(F.col("url")), F.lit(""))).alias("host_key"),
        "title",
        "text",
        "language",
        F.coalesce(F.size("links"), F.lit(0)).cast("int").alias("links"),
    ).withColumn("links", F.greatest("links", F.lit(0)))


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1: surely keywords, tags or links; 0: surely sentences; -1: not sure."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    spam = (
        (f["dull_share"] >= 0.5)
        | (f["tag_rate"] > 0.2)
        | (f["link_line_share"] > 0.4)
        | (f["top_pair"] > 0.09)
        | (f["top_triple"] > 0.12)
        | (f["short_line_share"] > 0.7)
    )
    plain = (
        (f["sentence_share"] >= 0.5)
        & (f["top_pair"] < 0.05)
        & (f["top_triple"] < 0.07)
        & (f["dull_share"] < 0.3)
        & (f["tag_rate"] < 0.02)
        & (f["link_line_share"] < 0.05)
    )
    return np.where(f["words"] < 5, -1, np.where(spam & ~plain, 1, np.where(plain & ~spam, 0, -1)))


def _facts(wrappers: Wrappers, more=None):
    """more: makes, in the worker, a function from a batch and its residuals to one more column."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FrameReader(wrappers)
        extra = more() if more else None
        for whole in batches:
            for batch in chunks(whole, "text"):
                titles = batch.column("title").to_pylist()
                residual = Residuals(reader, batch, titles, batch.column("links").to_numpy(zero_copy_only=False))
                x = residual.features().astype(np.float32)
                noticed, content, _ = residual.notices()
                share = np.where(content > 0, noticed / np.maximum(1, content), 0)
                marks = residual.placeholders()
                has_text = np.array([bool(t and t.strip()) for t in batch.column("text").to_pylist()], dtype=bool)
                weak = np.where((marks > 0) | (share >= NOTICE_SHARE) | ~has_text, -1, weak_labels(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("host_key"),
                        pa.array(list(x), pa.list_(pa.float32())),
                        pa.array(weak.astype(np.int32)),
                        pa.array(marks.astype(np.int32)),
                        pa.array(share.astype(np.float32)),
                        pa.array(has_text),
                        pa.array(content.astype(np.float64)),
                        residual.bodyless_lines(),
                        *([extra(batch, residual)] if extra else []),
                    ],
                    names=["page_id", "host_key", "features", "weak", "placeholders", "notice_share", "has_text", "content", "bare", *(["languages"] if extra else [])],
                )

    return rows


def page_facts(pages: DataFrame, wrappers: Wrappers, more=None, field: str = "") -> DataFrame:
    """One row per page (FACT_SCHEMA), kept in the shared folder: several steps read it."""
    schema = FACT_SCHEMA + (", " + field if field else "")
    read = cut(pages.select("page_id", "host_key", "title", "text", "language", "links", *extra(pages)).mapInArrow(_facts(wrappers, more), schema))
    return cut(residue.with_learned(read))


def residue_pages(facts: DataFrame) -> DataFrame:
    """page_id of the pages with template residue or an error, filler or script notice for content."""
    return facts.where((F.col("placeholders") > 0) | (F.col("has_text") & (F.col("notice_share") >= NOTICE_SHARE))).select("page_id").distinct()


def hashed_sample(df: DataFrame, key: str, most: int, rows: int) -> list:
    """The rows of least key hash, at most `most`, of a table of `rows` rows.

    The hash is cut at the share that is wanted, so that tasks send the sample only; an
    ordered limit would have each of them send as many rows as the whole sample.
    """
    marked = df.withColumn("sample_hash", F.xxhash64(key))
    share = min(1.0, (1.2 * most + 50) / max(1, rows))
    if share < 1.0:
        marked = marked.where(F.col("sample_hash") < int((2 * share - 1) * (1 << 63)))
    return sorted(marked.collect(), key=lambda r: (r.sample_hash, r[key]))[:most]


def fit_spam(facts: DataFrame) -> trees.Forest:
    """Trees from the weak labels of a bounded sample, the pages of least hash of either class."""
    counts = {r.weak: r["count"] for r in facts.groupBy("weak").count().collect()}
    picked = []
    for label in (0, 1):
        part = hashed_sample(facts.where(F.col("weak") == label).select("page_id", "features"), "page_id", TRAINING_PAGES, counts.get(label, 0))
        picked.append(np.array([r.features for r in part], dtype=np.float32).reshape(-1, len(FEATURES)))
    x = np.concatenate(picked)
    y = np.r_[np.zeros(len(picked[0])), np.ones(len(picked[1]))]
    return trees.fit(x, y)


def _scored(forest: trees.Forest):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            p = forest.predict(flat.reshape(-1, len(FEATURES))) if len(flat) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host_key"), pa.array(p)], names=["page_id", "host_key", "own"])

    return rows


def spam_scores(facts: DataFrame) -> DataFrame:
    """page_id, own (the trees' vote), host_rate and spam (the vote smoothed by the host's rate)."""
    forest = fit_spam(facts)
    usable = facts.where(F.col("has_text") & (F.col("placeholders") == 0) & (F.col("notice_share") < NOTICE_SHARE))
    own = usable.select("page_id", "host_key", "features").mapInArrow(_scored(forest), "page_id long, host_key long, own double")
    hosts = own.groupBy("host_key").agg(F.sum("own").alias("hits"), F.count("*").alias("n"))
    overall = hosts.agg((F.sum("hits") + 0.5).alias("all_hits"), (F.sum("n") + 1.0).alias("all_n"))
    mean = F.col("all_hits") / F.col("all_n")
    rates = hosts.crossJoin(F.broadcast(overall)).select("host_key", ((F.col("hits") + 10 * mean) / (F.col("n") + 10)).alias("host_rate"), mean.alias("mean_rate"))
    logit = lambda c: F.log(c / (1 - c))
    clipped = F.least(F.greatest(F.col("own"), F.lit(0.005)), F.lit(0.995))
    z = logit(clipped) + HOST_WEIGHT * (logit(F.col("host_rate")) - logit(F.col("mean_rate")))
    return own.join(rates, "host_key", "left").select("page_id", "host_key", "own", "host_rate", (1 / (1 + F.exp(-F.coalesce(z, logit(clipped))))).alias("spam"))


def spam_pages(facts: DataFrame) -> DataFrame:
    """page_id of the pages that are keywords, tags or links for the most part."""
    return spam_scores(facts).where(F.col("spam") >= SPAM_CUT).select("page_id").distinct()


def judged(df: DataFrame) -> tuple[DataFrame, Wrappers, DataFrame]:
    """crawled_pages as read, the wrappers of its sites and the facts of its pages."""
    read = crawled(df)
    learned = learn(read)
    pages = learned.on(read)
    return pages, learned.wrappers, page_facts(pages, learned.wrappers)


__all__ = ["crawled", "fit_spam", "judged", "page_facts", "residue", "residue_pages", "spam_pages", "spam_scores"]
