"""Ranking metrics, judgments, splits and significance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.ranking import _LISTS, results_of
from webloom.registry import query
from webloom.session import table

#: Gains up to this number are resampled on the driver (8 bytes each).
MAX_GAINS = 100_000


def judgments_of(spark, folder) -> DataFrame:
    """One grade per query and url: the newest that was given."""
    rows = table(spark, folder, "judgments")
    return rows.groupBy("query", "url").agg(
        F.max_by("grade", F.struct(F.coalesce("observed_at", F.lit("1970-01-01").cast("timestamp_ntz")), "grade")).alias("grade"),
        F.max("cluster_id").alias("cluster_id"),
        F.max("navigational").alias("navigational"),
    )


_QRELS = """qrels AS (SELECT query, url, arg_max(grade, struct_pack(o := coalesce(observed_at, TIMESTAMP '1970-01-01'), g := grade)) AS grade, max(cluster_id) AS cluster_id, max(navigational) AS navigational FROM judgments GROUP BY query, url)"""


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked rows (query_id, query, url, rank) with their grade; a missing grade is 0."""
    return ranked.join(qrels, ["query", "url"], "left").select(ranked["*"], F.coalesce("grade", F.lit(0)).alias("grade"), "cluster_id")


def one_list(spark, folder) -> DataFrame:
    """Each run's urls in one order by score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    best = results_of(spark, folder).groupBy("query_id", "query", "url").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order))


_ONE = f"""{_LISTS}, m AS (SELECT query_id, query, url, max(score) AS score FROM l GROUP BY query_id, query, url), one AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM m), {_QRELS},
jr AS (SELECT one.*, coalesce(grade, 0) AS grade, cluster_id FROM one LEFT JOIN qrels USING (query, url) WHERE query IN (SELECT query FROM judgments))"""


def judged_runs(spark, folder) -> DataFrame:
    qrels = judgments_of(spark, folder)
    runs = one_list(spark, folder).join(qrels.select("query").distinct(), "query", "left_semi")
    return judged(runs, qrels)


@query(f"WITH {_ONE} SELECT query_id, url, rank::int AS rank, grade FROM jr")
def j16_judgment_join(spark, folder):
    return judged_runs(spark, folder).select("query_id", "url", "rank", "grade")


def ndcg(rows: DataFrame, depth: int = 10) -> DataFrame:
    """Discounted gain over that of the best order; null without a relevant row."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    gain = F.pow(F.lit(2.0), F.least("grade", F.lit(30))) - 1
    part = lambda r: F.sum(F.when(r <= depth, gain / F.log2(r + 1)).otherwise(0.0))
    sums = rows.withColumn("ideal", ideal).groupBy("query_id").agg(part(F.col("rank")).alias("dcg"), part(F.col("ideal")).alias("best"))
    return sums.select("query_id", F.round("dcg", 9).alias("dcg"), F.when(F.col("best") > 0, F.round(F.col("dcg") / F.col("best"), 9)).alias("ndcg"))


@query(f"""WITH {_ONE}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM jr),
s AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM i GROUP BY query_id)
SELECT query_id, round(dcg, 9) AS dcg, CASE WHEN best > 0 THEN round(dcg / best, 9) END AS ndcg FROM s""")
def w9_ndcg(spark, folder):
    return ndcg(judged_runs(spark, folder))


@query(f"""WITH {_ONE}, r AS (SELECT *, (pow(2, grade) - 1) / 8.0 AS p FROM jr WHERE rank <= 20), c AS (SELECT query_id, rank, p, coalesce(exp(sum(ln(1 - p)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS go FROM r)
SELECT query_id, round(sum(p * go / rank), 9) AS err FROM c GROUP BY query_id""")
def w10_expected_reciprocal_rank(spark, folder):
    """Grades stop at 3 of a scale of 8, so no row stops every reader and the logarithm is finite."""
    p = (F.pow(F.lit(2.0), F.col("grade")) - 1) / 8.0
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = judged_runs(spark, folder).where("rank <= 20").withColumn("p", p).withColumn("go", F.coalesce(F.exp(F.sum(F.log(1 - F.col("p"))).over(before)), F.lit(1.0)))
    return rows.groupBy("query_id").agg(F.round(F.sum(F.col("p") * F.col("go") / F.col("rank")), 9).alias("err"))


@query(f"""WITH {_ONE}, i AS (SELECT jr.query_id, jr.rank, unnest(intents) AS intent FROM jr JOIN (SELECT query, url, max(intents) AS intents FROM judgments GROUP BY query, url) j USING (query, url) WHERE jr.grade > 0 AND rank <= 10),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, intent ORDER BY rank) - 1 AS seen FROM i)
SELECT query_id, round(sum(pow(0.5, seen) / log2(rank + 1)), 9) AS alpha_dcg, count(DISTINCT intent)::bigint AS intents FROM n GROUP BY query_id""")
def w11_intent_gain(spark, folder):
    """Each intent counts half as much every time it was seen before."""
    intents = table(spark, folder, "judgments").groupBy("query", "url").agg(F.max("intents").alias("intents"))
    rows = judged_runs(spark, folder).where("grade > 0 AND rank <= 10").join(intents, ["query", "url"]).select("query_id", "rank", F.explode("intents").alias("intent"))
    seen = F.row_number().over(Window.partitionBy("query_id", "intent").orderBy("rank")) - 1
    gains = rows.withColumn("seen", seen)
    return gains.groupBy("query_id").agg(F.round(F.sum(F.pow(F.lit(0.5), F.col("seen")) / F.log2(F.col("rank") + 1)), 9).alias("alpha_dcg"), F.countDistinct("intent").alias("intents"))


@query(f"WITH {_ONE} SELECT query_id, round(coalesce(1.0 / min(CASE WHEN grade > 0 AND rank <= 200 THEN rank END), 0), 9)::double AS reciprocal FROM jr GROUP BY query_id")
def w12_reciprocal_rank(spark, folder):
    first = F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= 200), F.col("rank")))
    return judged_runs(spark, folder).groupBy("query_id").agg(F.round(F.coalesce(1.0 / first, F.lit(0.0)), 9).alias("reciprocal"))


@query(f"WITH {_ONE} SELECT query_id, round(sum(CASE WHEN grade >= 2 THEN 1.0::double / log2(rank + 1) ELSE 0 END) / sum(1.0::double / log2(rank + 1)), 9) AS exposure FROM jr WHERE rank <= 10 GROUP BY query_id")
def w13_discounted_exposure(spark, folder):
    discount = 1.0 / F.log2(F.col("rank") + 1)
    rows = judged_runs(spark, folder).where("rank <= 10")
    return rows.groupBy("query_id").agg(F.round(F.sum(F.when(F.col("grade") >= 2, discount).otherwise(0.0)) / F.sum(discount), 9).alias("exposure"))


@query(f"""WITH {_ONE}, t AS (SELECT query, count(DISTINCT coalesce(cluster_id, url)) AS total FROM qrels WHERE grade > 0 GROUP BY query)
SELECT query_id, round(count(DISTINCT CASE WHEN grade > 0 AND rank <= 100 THEN coalesce(cluster_id, url) END)::double / max(total), 9) AS recall FROM jr JOIN t USING (query) GROUP BY query_id""")
def a13_cluster_recall(spark, folder):
    """Different relevant clusters among the leading 100 rows, over all relevant ones."""
    qrels = judgments_of(spark, folder)
    total = qrels.where("grade > 0").groupBy("query").agg(F.countDistinct(F.coalesce("cluster_id", "url")).alias("total"))
    found = F.countDistinct(F.when((F.col("grade") > 0) & (F.col("rank") <= 100), F.coalesce("cluster_id", "url")))
    return judged_runs(spark, folder).join(total, "query").groupBy("query_id").agg(F.round(found / F.max("total"), 9).alias("recall"))


@query(f"""WITH {_ONE} SELECT query_id, round(1 - count(DISTINCT coalesce(cluster_id, url))::double / count(*), 9) AS duplicates, round(count(DISTINCT {U.registrable_sql(U.host_sql('url'))})::double / count(*), 9) AS coverage FROM jr WHERE rank <= 10 GROUP BY query_id""")
def a14_duplicates_and_coverage(spark, folder):
    rows = judged_runs(spark, folder).where("rank <= 10")
    n = F.count("*")
    return rows.groupBy("query_id").agg(
        F.round(1 - F.countDistinct(F.coalesce("cluster_id", "url")) / n, 9).alias("duplicates"), F.round(F.countDistinct(U.registrable(U.host(F.col("url")))) / n, 9).alias("coverage")
    )


@query("""WITH s AS (SELECT unnest(slices) AS slice, grade FROM judgments) SELECT slice, round(avg(grade), 9) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY grade) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY grade) AS p95, count(*)::bigint AS n FROM s GROUP BY slice""")
def a12_slice_metrics(spark, folder):
    """Mean and nearest-rank quantiles per slice."""
    rows = table(spark, folder, "judgments").select(F.explode("slices").alias("slice"), "grade")
    return rows.groupBy("slice").agg(F.round(F.avg("grade"), 9).alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY grade)").cast("int").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY grade)").cast("int").alias("p95"), F.count("*").alias("n"))


@query(f"""WITH {_QRELS}, i AS (SELECT query, url, max(CASE WHEN proximity_known AND proximity > 0.5 THEN 2 ELSE 1 END) AS grade FROM explain_results GROUP BY query, url)
SELECT query, url, grade, true AS curated FROM qrels UNION ALL SELECT query, url, grade, false FROM i WHERE query NOT IN (SELECT query FROM qrels) AND url IS NOT NULL""")
def z19_curated_over_implicit(spark, folder):
    """Curated judgments replace derived ones for the same query."""
    curated = judgments_of(spark, folder).select("query", "url", "grade")
    strong = F.coalesce(F.col("proximity_known") & (F.col("proximity") > 0.5), F.lit(False))
    implicit = table(spark, folder, "explain_results").where("url IS NOT NULL").groupBy("query", "url").agg(F.max(F.when(strong, 2).otherwise(1)).alias("grade"))
    rest = implicit.join(curated.select("query").distinct(), "query", "left_anti")
    return curated.withColumn("curated", F.lit(True)).unionByName(rest.withColumn("curated", F.lit(False)))


@query("SELECT query, string_agg(url || '=' || grade, ',' ORDER BY url) AS grades FROM (SELECT query, url, max(grade) AS grade FROM judgments GROUP BY query, url) GROUP BY query")
def l12_pseudo_judgments(spark, folder):
    best = table(spark, folder, "judgments").groupBy("query", "url").agg(F.max("grade").alias("grade"))
    listed = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("url", "grade"))).alias("g"))
    return listed.select("query", F.array_join(F.transform("g", lambda x: F.concat(x["url"], F.lit("="), x["grade"].cast("string"))), ",").alias("grades"))


@query("""WITH c AS (SELECT DISTINCT coalesce(cluster_id, url) AS cluster FROM judgments), h AS (SELECT cluster, ('0x' || substring(md5(cluster), 1, 8))::bigint / 4294967296.0 AS x FROM c)
SELECT cluster, CASE WHEN x < 0.70 THEN 'train' WHEN x < 0.85 THEN 'develop' ELSE 'test' END AS part FROM h""")
def l10_held_out_split(spark, folder):
    """A cluster's hash decides its part, so no cluster is in two."""
    clusters = table(spark, folder, "judgments").select(F.coalesce("cluster_id", "url").alias("cluster")).distinct()
    x = F.conv(F.substring(F.md5("cluster"), 1, 8), 16, 10).cast("long") / 4294967296.0
    return clusters.select("cluster", F.when(x < 0.70, "train").when(x < 0.85, "develop").otherwise("test").alias("part"))


def paired_bootstrap(gains: np.ndarray, resamples: int = 2000, seed: int = 1) -> tuple[float, float, float]:
    """Mean relative gain with the bounds of its 95 % interval; gains come from one row per query."""
    gains = np.asarray(gains, dtype=float)
    if not len(gains):
        return 0.0, 0.0, 0.0
    # one resample at a time: all picks at once would take 16 KB a query
    random = np.random.default_rng(seed)
    means = np.sort([gains[random.integers(0, len(gains), len(gains))].mean() for _ in range(resamples)])
    return float(gains.mean()), float(means[math.floor(0.025 * resamples)]), float(means[math.floor(0.975 * resamples)])


def _weighted_sums(resamples: int, seed: int):
    """Per batch: sums of gains and of weights in each resample; a query's weights are Poisson, from its own seed."""

    def rows(batches):
        for batch in batches:
            total, weight = np.zeros(resamples), np.zeros(resamples)
            for h, gain in zip(batch.column("h").to_pylist(), batch.column("gain").to_pylist()):
                picked = np.random.default_rng([seed, h & 0xFFFFFFFFFFFFFFFF]).poisson(1.0, resamples)
                total += picked * gain
                weight += picked
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(weight)], names=["i", "total", "weight"])

    return rows


def bootstrap_of_all(gains: DataFrame, resamples: int = 2000, seed: int = 1) -> tuple[int, float, float, float]:
    """Queries, mean gain and its interval over all rows (query_id, gain).

    Up to MAX_GAINS gains are resampled on the driver; beyond that every query gets Poisson
    weights where it lies, and only sums per resample are sent.
    """
    few = gains.select("query_id", "gain").limit(MAX_GAINS + 1).toPandas()
    if len(few) <= MAX_GAINS:
        return len(few), *paired_bootstrap(few.sort_values("query_id")["gain"].to_numpy(), resamples, seed)
    whole = gains.agg(F.count("*").alias("n"), F.avg("gain").alias("mean")).collect()[0]
    keyed = gains.select(F.xxhash64("query_id").alias("h"), F.col("gain").cast("double").alias("gain"))
    sums = keyed.mapInArrow(_weighted_sums(resamples, seed), "i long, total double, weight double").groupBy("i").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    means = np.sort([r.total / max(r.weight, 1.0) for r in sums.collect()])
    return whole.n, whole.mean, float(means[math.floor(0.025 * resamples)]), float(means[math.floor(0.975 * resamples)])


@query()
def a17_paired_bootstrap(spark, folder):
    """Gain of ordering by quality over ordering by score, with its interval, over all judged queries."""
    rows = judged_runs(spark, folder)
    best = results_of(spark, folder).groupBy("query_id", "url").agg(F.max(F.when(F.col("quality_known"), F.col("quality"))).alias("quality"))
    other = rows.join(best, ["query_id", "url"]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("quality").desc_nulls_last(), "url")))
    both = ndcg(rows).select("query_id", F.col("ndcg").alias("base")).join(ndcg(other).select("query_id", F.col("ndcg").alias("new")), "query_id").dropna()
    gains = both.select("query_id", ((F.col("new") - F.col("base")) / F.greatest("base", F.lit(1e-9))).alias("gain"))
    queries, mean, low, high = bootstrap_of_all(gains)
    return spark.createDataFrame([(queries, round(mean, 6), round(low, 6), round(high, 6))], "queries long, gain double, low double, high double")


def promoted(gain: float, low: float, clusters: int, recall_change: float, safety_change: float, latency: tuple[float, float]) -> tuple[bool, list[str]]:
    """Whether a model may replace another, with the reasons against it."""
    rules = [
        (gain >= 0.02, "gain below 2 %"),
        (clusters >= 20, "fewer than 20 clusters"),
        (low >= 0, "interval reaches below zero"),
        (recall_change >= 0, "recall falls"),
        (safety_change >= 0, "safety falls"),
        (latency[1] <= 1.2 * latency[0] + 2, "too slow"),
    ]
    against = [reason for ok, reason in rules if not ok]
    return not against, against
