"""Learning to rank and calibration on bounded samples of judged rows; inference as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.evaluation import judgments_of
from webloom.registry import query
from webloom.session import table

#: Judged rows on which models are fitted at most, and features of a row.
EXAMPLES = 100_000
#: Titles on which the character model is fitted at most, and titles scored at once (16 KB each).
FITTED, SCORED = 256, 1_000
FEATURES = ("retrieval_score", "quality", "spam_risk", "proximity", "function_word_fraction", "symbol_fraction", "alphabetic_fraction", "unique_token_fraction")
SIGNS = {"retrieval_score": 1, "quality": 1, "spam_risk": -1, "proximity": 1}


def known_features(rows: DataFrame) -> DataFrame:
    """Unknown evidence is null."""
    known = {n: F.when(F.col(f"{n}_known"), F.col(n)) for n in ("quality", "spam_risk", "proximity")}
    return rows.withColumns(known)


def normalised(rows: DataFrame, names: tuple[str, ...] = FEATURES, key: str = "query_id") -> DataFrame:
    """Distance from the run's median in quartile ranges, clipped to 8; missing becomes 0."""
    stats = rows.groupBy(key).agg(*[F.expr(f"percentile({n}, array(0.25, 0.5, 0.75))").alias(f"q_{n}") for n in names])
    joined = rows.join(stats, key)
    for n in names:
        span = F.col(f"q_{n}")[2] - F.col(f"q_{n}")[0]
        scaled = (F.col(n) - F.col(f"q_{n}")[1]) / F.when(span > 0, span).otherwise(1.0)
        joined = joined.withColumn(n, F.coalesce(F.least(F.lit(8.0), F.greatest(F.lit(-8.0), scaled)), F.lit(0.0))).drop(f"q_{n}")
    return joined


@query("""WITH k AS (SELECT query_id, explain_id, CASE WHEN quality_known THEN quality END AS q FROM explain_results), s AS (SELECT query_id, quantile_cont(q, 0.25) AS lo, quantile_cont(q, 0.5) AS m, quantile_cont(q, 0.75) AS hi FROM k GROUP BY query_id)
SELECT explain_id, round(coalesce(least(8, greatest(-8, (q - m) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END)), 0), 9)::double AS quality FROM k JOIN s USING (query_id)""")
def l3_robust_normalization(spark, folder):
    rows = normalised(known_features(table(spark, folder, "explain_results")), ("quality",))
    return rows.select("explain_id", F.round("quality", 9).alias("quality"))


def examples(spark, folder) -> pd.DataFrame:
    """Normalised features and grades of judged results, a bounded sample by hash."""
    rows = normalised(known_features(table(spark, folder, "explain_results")))
    joined = rows.join(judgments_of(spark, folder).select("query", "url", "grade"), ["query", "url"])
    picked = joined.select("query_id", "url", "grade", *FEATURES).orderBy(F.xxhash64("query_id", "url"), "query_id", "url").limit(EXAMPLES)
    return picked.toPandas().sort_values(["query_id", "url"]).reset_index(drop=True)


def _lambdas(score: np.ndarray, grade: np.ndarray, depth: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of one query, weighted by the change of NDCG."""
    n = len(score)
    order = np.argsort(-score, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(1, n + 1)
    gain = 2.0**grade - 1
    discount = np.where(rank <= depth, 1 / np.log2(rank + 1), 0)
    ideal = np.sort(gain)[::-1][:depth]
    best = float((ideal / np.log2(np.arange(2, len(ideal) + 2))).sum())
    if best <= 0:
        return np.zeros(n), np.zeros(n)
    better = grade[:, None] > grade[None]
    rho = 1 / (1 + np.exp(np.clip(score[:, None] - score[None], -50, 50)))
    change = np.abs((gain[:, None] - gain[None]) * (discount[:, None] - discount[None])) / best
    pull, curve = np.where(better, rho * change, 0), np.where(better, rho * (1 - rho) * change, 0)
    return pull.sum(1) - pull.sum(0), curve.sum(1) + curve.sum(0)


def fit_linear(x: np.ndarray, grade: np.ndarray, groups: list[np.ndarray], signs: np.ndarray, rate: float = 0.05, l2: float = 0.001, rounds: int = 200) -> np.ndarray:
    """Weights from zero by NDCG gradients; signs bound the direction, 8 the size."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        score = x @ w
        step = np.zeros_like(w)
        for rows in groups:
            step += x[rows].T @ _lambdas(score[rows], grade[rows])[0]
        w = np.clip(w + rate * (step / max(1, len(groups)) - l2 * w), -8, 8)
        w = np.where((signs > 0) & (w < 0) | (signs < 0) & (w > 0), 0.0, w)
    return w


def _groups(ids: pd.Series) -> list[np.ndarray]:
    return [np.asarray(v) for v in ids.groupby(ids).groups.values()]


def linear_score(weights: dict[str, float]) -> Column:
    """A model's score as one expression."""
    out = F.lit(0.0)
    for name, weight in sorted(weights.items()):
        out = out + F.lit(float(weight)) * F.col(name)
    return out


@query()
def l1_linear_model(spark, folder):
    """feature and weight of the linear ranking model."""
    data = examples(spark, folder)
    signs = np.array([SIGNS.get(n, 0) for n in FEATURES])
    w = fit_linear(data[list(FEATURES)].to_numpy(float), data["grade"].to_numpy(float), _groups(data["query_id"]), signs) if len(data) else np.zeros(len(FEATURES))
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(FEATURES, w)], "feature string, weight double")


@query("""SELECT explain_id, round(0.6 * quality - 0.4 * spam_risk + 0.2 * proximity, 9) AS score FROM explain_results WHERE quality_known AND spam_risk_known AND proximity_known""")
def l5_linear_inference(spark, folder):
    rows = table(spark, folder, "explain_results").where("quality_known AND spam_risk_known AND proximity_known")
    return rows.select("explain_id", F.round(linear_score({"quality": 0.6, "spam_risk": -0.4, "proximity": 0.2}), 9).alias("score"))


def fit_boosted(x: np.ndarray, grade: np.ndarray, groups: list[np.ndarray], trees: int = 32, depth: int = 3, bins: int = 32, rate: float = 0.1, l2: float = 1.0, leaf: int = 5) -> list[dict]:
    """Histogram trees on NDCG gradients with Newton leaves; nested dicts of feature, cut, left, right or value."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score, out = np.zeros(len(x)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> dict:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, -1)
        if level and len(rows) >= 2 * leaf:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                left_g, left_h, n = (np.bincount(binned[rows, f], weights=v, minlength=len(c) + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                gain[(n < leaf) | (len(rows) - n < leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            return {"value": rate * total_g / (total_h + l2)}
        _, f, k = best
        goes = binned[rows, f] <= k
        return {"feature": f, "cut": float(cuts[f][k]), "left": grow(rows[goes], g, h, level - 1), "right": grow(rows[~goes], g, h, level - 1)}

    def value(tree: dict, row: np.ndarray) -> float:
        while "value" not in tree:
            tree = tree["left"] if row[tree["feature"]] <= tree["cut"] else tree["right"]
        return tree["value"]

    for _ in range(trees):
        g, h = np.zeros(len(x)), np.zeros(len(x))
        for rows in groups:
            g[rows], h[rows] = _lambdas(score[rows], grade[rows])
        tree = grow(np.arange(len(x)), g, h, depth)
        out.append(tree)
        score += np.array([value(tree, r) for r in x])
    return out


def boosted_score(trees: list[dict], names: tuple[str, ...]) -> Column:
    """Trees as nested conditions; a missing split value ends its tree with 0."""

    def of(tree: dict) -> Column:
        if "value" in tree:
            return F.lit(float(tree["value"]))
        c = F.col(names[tree["feature"]])
        return F.when(c.isNull(), F.lit(0.0)).when(c <= tree["cut"], of(tree["left"])).otherwise(of(tree["right"]))

    out = F.lit(0.0)
    for tree in trees:
        out = out + of(tree)
    return out


@query()
def l2_boosted_rerank(spark, folder):
    """Places of the leading 100 rows of each run by the boosted model; equal scores keep their order (t12)."""
    data = examples(spark, folder)
    trees = fit_boosted(data[list(FEATURES)].to_numpy(float), data["grade"].to_numpy(float), _groups(data["query_id"]), trees=12) if len(data) else []
    rows = normalised(known_features(table(spark, folder, "explain_results")))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "url", "explain_id")
    ranked = rows.withColumn("rank", F.row_number().over(first)).withColumn("model", F.when(F.col("rank") <= 100, boosted_score(trees, FEATURES)))
    order = Window.partitionBy("query_id").orderBy(F.col("model").desc_nulls_last(), "rank")
    return ranked.select("explain_id", F.row_number().over(order).alias("place"))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: thresholds and values that never fall."""
    blocks: list[list[float]] = []
    for xi, yi, wi in sorted(zip(x, y, w)):
        blocks.append([xi, yi, wi])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            _, y2, w2 = blocks.pop()
            x1, y1, w1 = blocks[-1]
            blocks[-1] = [x1, (y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


@query()
def l6_isotonic_calibration(spark, folder):
    """threshold and value: share of clicked events by value, made monotone over 200 equal steps."""
    events = table(spark, folder, "events").where("value IS NOT NULL")
    bounds = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()[0]
    step = ((bounds.hi or 0.0) - (bounds.lo or 0.0)) / 200 or 1.0
    binned = events.groupBy(F.floor((F.col("value") - (bounds.lo or 0.0)) / step).alias("b")).agg(F.avg((F.col("event_type") == "click").cast("double")).alias("y"), F.count("*").alias("w")).toPandas()
    x, y = isotonic(binned["b"].to_numpy(float) * step + (bounds.lo or 0.0), binned["y"].to_numpy(float), binned["w"].to_numpy(float))
    return spark.createDataFrame([(round(float(a), 6), round(float(b), 6)) for a, b in zip(x, y)], "threshold double, value double")


def platt(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic calibration by Newton steps with line search."""
    a, b = 0.0, 0.0
    target = (y * w + 1) / (w + 2)

    def loss(a: float, b: float) -> float:
        z = np.clip(a * x + b, -500, 500)
        return float((w * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        ga, gb = float((w * (p - target) * x).sum()), float((w * (p - target)).sum())
        c = w * p * (1 - p)
        haa, hab, hbb = float((c * x * x).sum()) + 1e-9, float((c * x).sum()), float(c.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12 or abs(ga) + abs(gb) < 1e-9:
            break
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        size, now = 1.0, loss(a, b)
        while size > 1e-8 and loss(a + size * da, b + size * db) > now - 1e-12:
            size /= 2
        if size <= 1e-8:
            break
        a, b = a + size * da, b + size * db
    return a, b


@query()
def l7_platt_calibration(spark, folder):
    events = table(spark, folder, "events").where("value IS NOT NULL")
    binned = events.groupBy(F.round("value", 1).alias("x")).agg(F.avg((F.col("event_type") == "click").cast("double")).alias("y"), F.count("*").alias("w"))
    binned = binned.orderBy(F.xxhash64("x"), "x").limit(EXAMPLES).toPandas()  # the bins of least hash
    a, b = platt(binned["x"].to_numpy(float), binned["y"].to_numpy(float), binned["w"].to_numpy(float))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "slope double, offset double")


def coordinate_ascent(objective, start: np.ndarray, steps=(0.5, 0.8, 1.25, 2.0), seeds=(0.1, 0.25, 0.5), rounds: int = 8, least: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights improved one at a time; a weight of zero is tried at the seeds."""
    best, top = np.array(start, float), objective(start)
    for _ in range(rounds):
        before = top
        for i in range(len(best)):
            for value in [best[i] * s for s in steps] if best[i] else seeds:
                trial = best.copy()
                trial[i] = value
                score = objective(trial)
                if score > top + 1e-12:
                    best, top = trial, score
        if top - before < least:
            break
    return best, top


def ngram_features(texts: list[str], size: int = 4096) -> np.ndarray:
    """Signed hashes of character 3- to 5-grams, unit length."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    for row, text in enumerate(texts):
        low = " ".join((text or "").lower().split())
        for n in (3, 4, 5):
            for i in range(len(low) - n + 1):
                h = xxhash.xxh3_64_intdigest(low[i : i + n])
                out[row, h % size] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.4) -> tuple[np.ndarray, float]:
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        w -= rate * (x.T @ (p - y)) / len(y) * 10
        b -= rate * float((p - y).mean())
    return w, b


def character_scores(titles: DataFrame, w: np.ndarray, b: float) -> DataFrame:
    """doc_id, label and score of every title; above 0 the model says German."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED):
                part = batch.slice(at, SCORED)
                score = ngram_features(part.column("title").to_pylist()) @ w + b
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(score, pa.float64())], names=["doc_id", "label", "score"])

    return titles.select("doc_id", "label", "title").mapInArrow(rows, "doc_id long, label boolean, score double")


def character_model(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of all titles, and the documents on whose titles the model is fitted: of least hash, FITTED at most."""
    code = F.lower(F.trim("lang"))
    german = F.when(code.rlike("^(de|deu|ger|deutsch|german)([-_].*)?$"), True).when(code.rlike("^(en|eng|english)([-_].*)?$"), False)
    titles = documents.where("title IS NOT NULL").select("doc_id", "title", german.alias("label"))
    labelled = titles.where("label IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    # even hashes may be fitted on, so that small tables, too, keep titles to be tested on
    sample = labelled.where(F.pmod("h", F.lit(2)) == 0).orderBy("h", "doc_id").limit(FITTED).toPandas()
    x, y = ngram_features(list(sample["title"])), sample["label"].to_numpy(float)
    w, b = fit_logistic(x, y) if len(sample) else (np.zeros(x.shape[1]), 0.0)
    fitted = documents.sparkSession.createDataFrame([(int(i),) for i in sample["doc_id"]], "doc_id long")
    return character_scores(titles, w, b), fitted


@query()
def l8_character_model(spark, folder):
    """Share of all titles outside the fitted sample whose kind (German or English) the character model tells."""
    scores, fitted = character_model(table(spark, folder, "documents"))
    held = scores.where("label IS NOT NULL").join(F.broadcast(fitted), "doc_id", "left_anti")
    right = F.avg(((F.col("score") > 0) == F.col("label")).cast("double"))
    return held.agg(F.count("*").alias("held_out"), F.round(F.coalesce(right, F.lit(0.0)), 4).alias("accuracy"))


@query("""SELECT explain_id, CASE WHEN spam_risk_known AND spam_risk > 0.8 THEN 'explicit' WHEN NOT spam_risk_known THEN 'unknown' ELSE 'unrated' END AS label FROM explain_results""")
def l9_structured_labels(spark, folder):
    """A low risk never means safe."""
    risky = F.col("spam_risk_known") & (F.col("spam_risk") > 0.8)
    return table(spark, folder, "explain_results").select("explain_id", F.when(risky, "explicit").when(~F.col("spam_risk_known"), "unknown").otherwise("unrated").alias("label"))
