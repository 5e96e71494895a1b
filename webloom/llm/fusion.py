"""One ranking of a run's urls from scores on unlike scales: robust rank aggregation.

Each score is turned into its normalised rank among the known values of the run (ties share
the mean rank); an unknown score stands at one half and so speaks neither for nor against.
An item's sorted ranks are held against the order statistics of uniform ranks: the least of
their beta probabilities, times the number of scores, is the item's significance, by which
the run is ranked. The mean rank and then the url break ties.

Ranks are counted without putting a run into one task: values are counted, spread by range,
counted up within each range and offset by the ranges before it.

Rows without query_id or url are left out, NaN counts as unknown. A url logged twice in a
run is one item with the mean of its known values.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import cut

#: column, column that tells whether it is known, is a high value good?
SCORES = (("retrieval_score", None, True), ("quality", "quality_known", True), ("spam_risk", "spam_risk_known", False), ("proximity", "proximity_known", True))


def items(df: DataFrame) -> DataFrame:
    """One row per run and url with its known scores."""
    known = []
    for name, flag, _ in SCORES:
        ok = F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
        if flag:
            ok = ok & F.coalesce(F.col(flag), F.lit(False))
        known.append(F.avg(F.when(ok, F.col(name).cast("double"))).alias(name))
    return df.where(F.col("query_id").isNotNull() & F.col("url").isNotNull()).groupBy("query_id", "url").agg(*known)


def counted_before(df: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    """Per keys and value: n (its rows) and before (rows of the same keys with a lower value)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    spread = cut(counts.repartitionByRange(ranges, *keys, value).withColumn("part", F.spark_partition_id()))
    parts = spread.groupBy(*keys, "part").agg(F.sum("n").alias("in_part"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return local.join(offsets, [*keys, "part"]).select(*keys, value, "n", (F.col("inside") + F.col("offset")).alias("before"))


def significance(ranks: Column, n: int = len(SCORES)) -> Column:
    """Corrected minimum of the beta order-statistic probabilities of n ascending ranks."""
    terms = []
    for k in range(1, n + 1):
        r = F.element_at(ranks, k)
        terms.append(reduce(lambda a, b: a + b, [F.lit(float(comb(n, j))) * F.pow(r, j) * F.pow(1 - r, n - j) for j in range(k, n + 1)]))
    return F.least(F.lit(1.0), F.lit(float(n)) * F.least(*terms))


def aggregated(df: DataFrame) -> DataFrame:
    """query_id, url, the four normalised ranks, mean_rank and significance of every item."""
    base = cut(items(df))
    struct = [F.struct(F.lit(i).alias("score"), (-F.col(name) if high else F.col(name)).alias("value")) for i, (name, _, high) in enumerate(SCORES)]
    long = base.select("query_id", "url", F.explode(F.array(*struct)).alias("s")).select("query_id", "url", "s.score", "s.value").where("value IS NOT NULL")
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = counted_before(long, ["query_id", "score"], "value", ranges)
    totals = before.groupBy("query_id", "score").agg(F.sum("n").alias("known"))
    rank = before.join(totals, ["query_id", "score"]).select("query_id", "score", "value", ((F.col("before") + (F.col("n") + 1) / 2) / F.col("known")).alias("rank"))
    ranked = long.join(rank, ["query_id", "score", "value"])
    wide = ranked.groupBy("query_id", "url").agg(*[F.max(F.when(F.col("score") == i, F.col("rank"))).alias(f"rank_{name}") for i, (name, _, _) in enumerate(SCORES)])
    names = [f"rank_{name}" for name, _, _ in SCORES]
    full = base.select("query_id", "url").join(wide, ["query_id", "url"], "left").select("query_id", "url", *[F.coalesce(n, F.lit(0.5)).alias(n) for n in names])
    ordered = F.sort_array(F.array(*names))
    return full.select("*", (reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)).alias("mean_rank"), significance(ordered).alias("significance"))


def first_places(df: DataFrame) -> DataFrame:
    """query_id and the url in first place."""
    order = F.struct(F.round("significance", 12).alias("a"), F.round("mean_rank", 12).alias("b"), "url")
    return aggregated(df).groupBy("query_id").agg(F.min_by("url", order).alias("url"))


def ranking(df: DataFrame) -> DataFrame:
    """query_id, url, place (1 is best), significance and mean_rank."""
    scored = cut(aggregated(df).withColumn("key", F.struct(F.round("significance", 12).alias("a"), F.round("mean_rank", 12).alias("b"), "url")))
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = counted_before(scored, ["query_id"], "key", ranges)
    return scored.join(before, ["query_id", "key"]).select("query_id", "url", (F.col("before") + 1).cast("long").alias("place"), "significance", "mean_rank")


def _sql_ranks(name: str, flag: str | None, high: bool) -> str:
    sign = "-" if high else ""
    return (
        f"SELECT query_id, url, (rank() OVER (PARTITION BY query_id ORDER BY {sign}{name}) + (count(*) OVER (PARTITION BY query_id, {name}) - 1) / 2.0)"
        f" / count(*) OVER (PARTITION BY query_id) AS r FROM items WHERE {name} IS NOT NULL"
    )


def ranking_sql(select: str) -> str:
    """The same in SQL; select reads the table placed(query_id, url, place, significance, mean_rank)."""
    known = ", ".join(f"avg({n}::double) FILTER (WHERE {n} IS NOT NULL AND NOT isnan({n}::double){' AND ' + f if f else ''}) AS {n}" for n, f, _ in SCORES)
    parts = ", ".join(f"r{i} AS ({_sql_ranks(*s)})" for i, s in enumerate(SCORES))
    joins = " ".join(f"LEFT JOIN r{i} ON r{i}.query_id = items.query_id AND r{i}.url = items.url" for i in range(len(SCORES)))
    ranks = ", ".join(f"coalesce(r{i}.r, 0.5)" for i in range(len(SCORES)))
    n = len(SCORES)
    beta = ", ".join("(" + " + ".join(f"{comb(n, j)} * pow(o[{k}], {j}) * pow(1 - o[{k}], {n - j})" for j in range(k, n + 1)) + ")" for k in range(1, n + 1))
    return (
        f"WITH items AS (SELECT query_id, url, {known} FROM explain_results WHERE query_id IS NOT NULL AND url IS NOT NULL GROUP BY query_id, url), {parts}, "
        f"ordered AS (SELECT items.query_id, items.url, list_sort([{ranks}]) AS o FROM items {joins}), "
        f"scored AS (SELECT query_id, url, least(1.0, {float(n)} * least({beta})) AS significance, (o[1] + o[2] + o[3] + o[4]) / {n} AS mean_rank FROM ordered), "
        "placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(significance, 12), round(mean_rank, 12), url) AS place FROM scored) " + select
    )
