"""Aggregates over events, clicks and runs: facets, evidence, reputation, rates and schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.registry import query
from webloom.session import table

FACETS = ("host", "filetype", "language", "protocol", "month")


def facets(rows: DataFrame, columns: tuple[str, ...], best: int = 8, longest: int = 48) -> DataFrame:
    """facet, term, n: the leading terms of several columns, counted in one pass.

    The columns are unpivoted and counted together, so each row is read once and the
    shuffle carries only combined counts. Blank and overlong labels are left out.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("term")) for c in columns])).alias("x")).select("x.*")
    counted = long.where((F.trim("term") != "") & (F.octet_length("term") <= longest)).groupBy("facet", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "term")
    return counted.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= best).select("facet", "term", "n")


_FACET = f"""c AS (SELECT {U.host_sql('url')} AS host, {U.extension_sql('url')} AS filetype, language, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS protocol, strftime(fetched_at, '%Y-%m') AS month FROM crawled_pages),
u AS (SELECT 'host' AS facet, host AS term FROM c UNION ALL SELECT 'filetype', filetype FROM c UNION ALL SELECT 'language', language FROM c UNION ALL SELECT 'protocol', protocol FROM c UNION ALL SELECT 'month', month FROM c)"""


@query(f"""WITH {_FACET}, n AS (SELECT facet, term, count(*)::bigint AS n FROM u WHERE trim(term) <> '' AND octet_length(encode(term)) <= 48 GROUP BY facet, term)
SELECT facet, term, n FROM n QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, term) <= 8""")
def a1_facets(spark, folder):
    u = F.col("url")
    rows = table(spark, folder, "crawled_pages").select(U.host(u).alias("host"), U.extension(u).alias("filetype"), "language", U.scheme(u).alias("protocol"), F.date_format("fetched_at", "yyyy-MM").alias("month"))
    return facets(rows, FACETS)


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*)::bigint AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS nth FROM events GROUP BY event_type, user_id) WHERE nth <= 10")
def a2_heavy_hitters(spark, folder):
    """Exact counts; the bounded synopsis of one process has no place in a distributed aggregate."""
    counted = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    return counted.withColumn("nth", F.row_number().over(order)).where("nth <= 10").select("event_type", "user_id", "n")


def decayed_reputation(observations: DataFrame, half_life_days: float = 7.0, prior: float = 2.0) -> DataFrame:
    """peer, reliability and weight from (peer, success, failure, age_days) evidence."""
    fade = F.pow(F.lit(2.0), -F.col("age_days") / half_life_days)
    sums = observations.groupBy("peer").agg(F.sum(F.col("success") * fade).alias("s"), F.sum(F.col("failure") * fade).alias("f"))
    reliability = (F.col("s") + prior) / (F.col("s") + F.col("f") + 2 * prior)
    return sums.select("peer", F.round(reliability, 9).alias("reliability"), F.round(F.least(F.lit(1.5), F.greatest(F.lit(0.25), 2 * reliability)), 9).alias("weight"))


def observations_of(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    now = events.agg(F.max("ts").alias("now"))
    outcome = F.col("event_type")
    failure = F.when(outcome == "error", 1.0).when(outcome == "refund", 2.0).when(outcome == "logout", 0.5).otherwise(0.0)
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    return events.crossJoin(F.broadcast(now)).select((F.col("user_id") % 50).alias("peer"), F.when(failure == 0, 1.0).otherwise(0.0).alias("success"), failure.alias("failure"), age.alias("age_days"))


_OBS = """ob AS (SELECT user_id % 50 AS peer, CASE event_type WHEN 'error' THEN 1.0 WHEN 'refund' THEN 2.0 WHEN 'logout' THEN 0.5 ELSE 0.0 END::double AS failure, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0 AS age FROM events),
rs AS (SELECT peer, sum(CASE WHEN failure = 0 THEN pow(2, -age / 7.0) ELSE 0 END) AS s, sum(failure * pow(2, -age / 7.0)) AS f FROM ob GROUP BY peer)"""


@query(f"WITH {_OBS} SELECT peer, round((s + 2) / (s + f + 4), 9) AS reliability, round(least(1.5, greatest(0.25, 2 * (s + 2) / (s + f + 4))), 9) AS weight FROM rs")
def a9_peer_reputation(spark, folder):
    return decayed_reputation(observations_of(spark, folder))


@query(f"""WITH {_OBS}, w AS (SELECT peer, peer % 5 AS network, least(1.5, greatest(0.25, 2 * (s + 2) / (s + f + 4))) AS weight FROM rs)
SELECT peer, round(weight * least(1.0, 8.0 / sum(weight) OVER (PARTITION BY network)), 6) AS capped FROM w""")
def a10_network_cap(spark, folder):
    """Weights of one network are scaled down to at most 8 together."""
    weights = decayed_reputation(observations_of(spark, folder)).withColumn("network", F.col("peer") % 5)
    total = F.sum("weight").over(Window.partitionBy("network"))
    return weights.select("peer", F.round(F.col("weight") * F.least(F.lit(1.0), 8.0 / total), 6).alias("capped"))


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval of a share."""
    p = successes / trials
    centre = p + z * z / (2 * trials)
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return (centre - half) / (1 + z * z / trials), (centre + half) / (1 + z * z / trials)


@query("""WITH c AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS k FROM events GROUP BY user_id), p AS (SELECT *, k::double / n AS p FROM c)
SELECT user_id, n::bigint AS impressions, k::bigint AS clicks, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS low,
round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS high FROM p""")
def a11_click_evidence(spark, folder):
    counted = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("impressions"), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks"))
    low, high = wilson(F.col("clicks").cast("double"), F.col("impressions").cast("double"))
    return counted.select("user_id", "impressions", "clicks", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("""SELECT user_id, max(ts) AS last, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS state, count(*)::bigint AS events, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::bigint AS errors FROM events GROUP BY user_id""")
def a19_run_tally(spark, folder):
    """Counters and newest state per run; z16 keeps the same registry."""
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("events"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors")
    )


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), c AS (SELECT hour, sum(n) OVER (ORDER BY hour) AS total FROM h)
SELECT hour, round(greatest(0, total - lag(total) OVER (ORDER BY hour)) / (epoch(hour) - epoch(lag(hour) OVER (ORDER BY hour))), 9)::double AS rate FROM c""")
def a20_counter_rates(spark, folder):
    """Per-second rates of a cumulative counter; a counter that falls gives 0. One row per hour."""
    hours = table(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    w = Window.orderBy("hour")
    counter = hours.withColumn("total", F.sum("n").over(w))
    step = F.col("total") - F.lag("total").over(w)
    seconds = F.unix_seconds(F.col("hour").cast("timestamp")) - F.unix_seconds(F.lag("hour").over(w).cast("timestamp"))
    return counter.select(F.col("hour").cast("timestamp_ntz").alias("hour"), F.round(F.greatest(F.lit(0), step) / seconds, 9).alias("rate"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey)::bigint AS customers FROM orders GROUP BY o_orderpriority")
def a22_count_distinct(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, count(*)::bigint AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def a23_grouping_sets(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH s AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), m AS (SELECT query_median.s, m, hi - lo AS iqr FROM (SELECT s, quantile_cont(q, 0.5) AS m, quantile_cont(q, 0.25) AS lo, quantile_cont(q, 0.75) AS hi FROM s GROUP BY s) query_median)
SELECT s.s, s.p, round(least(8, greatest(-8, (q - m) / CASE WHEN iqr > 0 THEN iqr ELSE 1 END)), 9) AS scaled FROM s JOIN m ON s.s = m.s""")
def c40_robust_scale(spark, folder):
    """Distance from the group's median in quartile ranges, clipped; l3 applies it per query."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.max("l_quantity").alias("q"))
    stats = rows.groupBy("s").agg(*[F.expr(f"percentile(q, {x})").alias(n) for x, n in ((0.25, "lo"), (0.5, "m"), (0.75, "hi"))])
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return rows.join(stats, "s").select("s", "p", F.round(F.least(F.lit(8.0), F.greatest(F.lit(-8.0), (F.col("q") - F.col("m")) / span)), 9).alias("scaled"))


@query("SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS logistic, least(5000, greatest(0, c_acctbal))::double AS clamped FROM customer")
def c41_logistic(spark, folder):
    x = F.col("c_acctbal")
    return table(spark, folder, "customer").select("c_custkey", F.round(1 / (1 + F.exp(-x / 1000)), 9).alias("logistic"), F.least(F.lit(5000.0), F.greatest(F.lit(0.0), x)).alias("clamped"))


@query("""WITH r AS (SELECT explain_id, query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url, explain_id) AS rank FROM explain_results)
SELECT a.explain_id AS upper, b.explain_id AS lower, (substring(md5(a.query_id || ':' || a.rank), 1, 1) < '8') AS swapped FROM r a JOIN r b ON a.query_id = b.query_id AND b.rank = a.rank + 1 WHERE a.rank % 2 = 1""")
def w14_adjacent_pairs(spark, folder):
    """Neighbouring results as fair pairs; half of them, decided by hash, swap places."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url", "explain_id")
    rows = table(spark, folder, "explain_results").select("query_id", "explain_id", F.row_number().over(order).alias("rank"), F.lead("explain_id").over(order).alias("lower"))
    coin = F.substring(F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("rank").cast("string"))), 1, 1) < "8"
    return rows.where((F.col("rank") % 2 == 1) & F.col("lower").isNotNull()).select(F.col("explain_id").alias("upper"), "lower", coin.alias("swapped"))


def _draft(rows: pd.DataFrame) -> pd.DataFrame:
    """Both rankings draft in turn; a coin from the query decides who begins each round."""
    lists = {k: list(g.sort_values("rank")["url"]) for k, g in rows.groupby("list")}
    a, b = lists.get("a", []), lists.get("b", [])
    query_id = int(rows["query_id"].iloc[0])
    seen, out, turn = set(), [], 0
    while a or b:
        first = "ab" if ((query_id * 2654435761 + turn * 40503) >> 7) & 1 else "ba"
        for team in first:
            left = a if team == "a" else b
            while left and left[0] in seen:
                left.pop(0)
            if left:
                seen.add(left[0])
                out.append((left.pop(0), team))
        turn += 1
        if len(out) >= 50:
            break
    return pd.DataFrame({"query_id": query_id, "place": range(1, len(out) + 1), "url": [o[0] for o in out], "team": [o[1] for o in out]})


@query()
def w15_team_draft(spark, folder):
    """Interleaving of the order by score and the order by quality, the leading 50 rows of each."""
    base = table(spark, folder, "explain_results").where("url IS NOT NULL").groupBy("query_id", "url").agg(F.max("score").alias("score"), F.max("quality").alias("quality"))
    parts = []
    for name, column in (("a", "score"), ("b", "quality")):
        order = Window.partitionBy("query_id").orderBy(F.col(column).desc_nulls_last(), "url")
        parts.append(base.select("query_id", "url", F.lit(name).alias("list"), F.row_number().over(order).alias("rank")).where("rank <= 50"))
    return parts[0].unionByName(parts[1]).groupBy("query_id").applyInPandas(_draft, "query_id long, place int, url string, team string")


@query(f"""SELECT word, count(*)::bigint AS n FROM (SELECT unnest({T.tokens_sql('query')}) AS word FROM explain_results) WHERE length(word) >= 2 GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def z14_query_words(spark, folder):
    words = table(spark, folder, "explain_results").select(F.explode(T.tokens(F.col("query"))).alias("word")).where(F.length("word") >= 2)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("SELECT event_type, count(*)::bigint AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def z15_transfer_totals(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey < 20 ORDER BY s_acctbal DESC, s_suppkey LIMIT 16")
def z12_best_roster(spark, folder):
    return table(spark, folder, "supplier").where("s_nationkey < 20").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(16).select("s_suppkey", "s_acctbal")


def ring_distance(start: Column, end: Column) -> Column:
    """Steps forward on the ring of 2^63 places; the order of operations keeps within a long."""
    last = F.lit((1 << 63) - 1)
    return F.when(end >= start, end - start).otherwise((last - start) + end + 1)


@query("""WITH p AS (SELECT s_suppkey, ('0x' || substring(md5(s_name), 1, 15))::bigint * 8 AS place FROM supplier), k AS (SELECT p_partkey, ('0x' || substring(md5(p_name), 1, 15))::bigint * 8 AS place FROM part),
d AS (SELECT p_partkey, s_suppkey, CASE WHEN p.place >= k.place THEN p.place - k.place ELSE (9223372036854775807 - k.place) + p.place + 1 END AS distance FROM k CROSS JOIN p)
SELECT p_partkey, s_suppkey, distance FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY distance, s_suppkey) <= 3""")
def j17_ring_targets(spark, folder):
    """The three nearest peers after each key on the ring.

    Keys and peers are ordered on one ring and each key looks ahead in it: peers are a
    roster of bounded size (checked), sorted once and searched, not crossed with the keys.
    """
    place = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long") * 8
    roster = table(spark, folder, "supplier").select(place("s_name").alias("place"), "s_suppkey").limit(200_001).collect()
    if len(roster) > 200_000:
        raise ValueError("more than 200,000 peers")
    ring = sorted((r.place, r.s_suppkey) for r in roster)
    keys = table(spark, folder, "part").select("p_partkey", place("p_name").alias("place"))
    return keys.mapInPandas(_nearest(ring, 3), "p_partkey long, s_suppkey long, distance long")


def _nearest(ring: list[tuple[int, int]], best: int):
    from bisect import bisect_left

    def rows(batches):
        places = [p for p, _ in ring]
        for batch in batches:
            out = []
            for key, place in zip(batch["p_partkey"], batch["place"]):
                at = bisect_left(places, place)
                near = [ring[(at + i) % len(ring)] for i in range(min(len(ring), best + 8))]
                found = sorted((p - place if p >= place else ((1 << 63) - 1 - place) + p + 1, peer) for p, peer in near)
                out += [(key, peer, distance) for distance, peer in found[:best]]
            yield pd.DataFrame(out, columns=["p_partkey", "s_suppkey", "distance"])

    return rows


@query("SELECT p_partkey, (('0x' || substring(md5(p_name), 1, 15))::bigint * 8) >> 59 AS partition FROM part")
def c6_ring_partition(spark, folder):
    """The vertical partition of a key: the leading bits of its place."""
    place = F.conv(F.substring(F.md5("p_name"), 1, 15), 16, 10).cast("long") * 8
    return table(spark, folder, "part").select("p_partkey", F.shiftright(place, 59).alias("partition"))


@query("""SELECT url, arg_max(page_id, struct_pack(o := observed_at, i := page_id)) AS page_id, (max(observed_at) + INTERVAL 7 DAY) AS due FROM crawled_pages WHERE observed_at IS NOT NULL AND url IS NOT NULL GROUP BY url""")
def m10_recrawl_schedule(spark, folder):
    """The newest observation of each url and when it is due again."""
    pages = table(spark, folder, "crawled_pages").where("observed_at IS NOT NULL AND url IS NOT NULL")
    return pages.groupBy("url").agg(F.max_by("page_id", F.struct("observed_at", "page_id")).alias("page_id"), (F.max("observed_at") + F.expr("INTERVAL 7 DAYS")).alias("due"))


@query("""SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY observed_at DESC NULLS LAST, page_id DESC) = 1 THEN 'current' ELSE 'superseded' END AS state FROM crawled_pages WHERE url IS NOT NULL""")
def m3_late_observations(spark, folder):
    """Newest observation wins; order is (observed_at, id), undated rows are the oldest."""
    order = Window.partitionBy("url").orderBy(F.col("observed_at").desc_nulls_last(), F.desc("page_id"))
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL")
    return pages.select("page_id", F.when(F.row_number().over(order) == 1, "current").otherwise("superseded").alias("state"))


_OLD_NEW = f"""r AS (SELECT url, text, page_id, row_number() OVER (PARTITION BY url ORDER BY observed_at NULLS FIRST, page_id) AS nth, count(*) OVER (PARTITION BY url) AS n FROM crawled_pages WHERE url IS NOT NULL),
old AS (SELECT url, unnest(list_distinct({T.tokens_sql('text')})) AS word FROM r WHERE nth = 1 AND n > 1), new AS (SELECT url, unnest(list_distinct({T.tokens_sql('text')})) AS word FROM r WHERE nth = n AND n > 1)"""


@query(f"WITH {_OLD_NEW} SELECT url, word FROM old EXCEPT SELECT url, word FROM new")
def m4_stale_postings(spark, folder):
    """Words of the first observation that the newest no longer holds."""
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("url", "text", "page_id", "observed_at")
    order = Window.partitionBy("url").orderBy(F.col("observed_at").asc_nulls_first(), "page_id")
    rows = pages.select("url", "text", F.row_number().over(order).alias("nth"), F.count("*").over(Window.partitionBy("url")).alias("n")).where("n > 1")
    words = lambda df: df.select("url", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    return words(rows.where("nth = 1")).join(words(rows.where("nth = n")), ["url", "word"], "left_anti")


@query("""SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 300 THEN 1 ELSE 0 END)::bigint AS sessions, count(*)::bigint AS events FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY user_id""")
def m12_sessions(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (micros - F.lag(micros).over(w)) / 1e6
    rows = table(spark, folder, "events").select("user_id", (gap.isNull() | (gap > 300)).cast("int").alias("new"))
    return rows.groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("events"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*)::bigint AS n, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2")
def m13_event_windows(spark, folder):
    windowed = table(spark, folder, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"))
    return windowed.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


@query("""WITH s AS (SELECT page_id, octet_length(encode(coalesce(text, ''))) AS bytes, sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY fetched_at NULLS FIRST, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM crawled_pages)
SELECT page_id, bytes::bigint AS bytes FROM s WHERE coalesce(before, 0) < 200000""")
def m14_quota_eviction(spark, folder):
    """The stalest pages until enough room is freed: days are summed first, so that only one day is ordered row by row."""
    pages = table(spark, folder, "crawled_pages").select("page_id", "fetched_at", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.to_date("fetched_at").alias("day"))
    days = pages.groupBy("day").agg(F.sum("bytes").alias("d"))
    earlier = Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(F.col("day").alias("of"), F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("offset")).where("offset < 200000")
    within = Window.partitionBy("day").orderBy(F.col("fetched_at").asc_nulls_first(), "page_id").rowsBetween(Window.unboundedPreceding, -1)
    near = pages.join(offsets, pages["day"].eqNullSafe(offsets["of"]))
    return near.withColumn("before", F.col("offset") + F.coalesce(F.sum("bytes").over(within), F.lit(0))).where("before < 200000").select("page_id", "bytes")


@query("""SELECT url, count(*)::bigint AS fetches, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen, count(DISTINCT text)::bigint AS versions FROM crawled_pages WHERE url IS NOT NULL GROUP BY url""")
def k1_document_upsert(spark, folder):
    """Keyed merge of observations: first-seen kept, content versions counted by hash."""
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL")
    return pages.groupBy("url").agg(F.count("*").alias("fetches"), F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"), F.countDistinct(F.sha2(F.encode("text", "utf-8"), 256)).alias("versions"))


@query("SELECT page_id, url FROM crawled_pages WHERE url NOT IN (SELECT url FROM judgments WHERE grade = 0 AND url IS NOT NULL)")
def k2_document_purge(spark, folder):
    gone = table(spark, folder, "judgments").where("grade = 0 AND url IS NOT NULL").select("url").distinct()
    return table(spark, folder, "crawled_pages").where("url IS NOT NULL").join(gone, "url", "left_anti").select("page_id", "url")


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\",\"n_chars\":' || n_chars || '}' AS json FROM documents WHERE source IS NOT NULL")
def k6_json_rows(spark, folder):
    return table(spark, folder, "documents").where("source IS NOT NULL").select("doc_id", F.to_json(F.struct("doc_id", "source", "n_chars")).alias("json"))


@query("""SELECT query_id, count(*)::bigint AS results, round(max(score), 9) AS best FROM explain_results GROUP BY query_id""")
def k7_answer_usage(spark, folder):
    return table(spark, folder, "explain_results").groupBy("query_id").agg(F.count("*").alias("results"), F.round(F.max("score"), 9).alias("best"))


@query("SELECT l_suppkey AS s, sum(l_quantity)::double AS quantity FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY l_suppkey")
def z2_missing_rows(spark, folder):
    bad = table(spark, folder, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, folder, "lineitem").join(bad, "l_suppkey", "left_anti").groupBy(F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("quantity"))
