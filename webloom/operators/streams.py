"""Streams run over whole tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.registry import query
from webloom.streaming import ingest


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*)::bigint AS n FROM events GROUP BY 1, 2")
def m1_micro_batch_windows(spark, folder):
    done = ingest.run_to_end(ingest.windowed_counts(ingest.stream_of(spark, f"{folder}/events.parquet")), "complete")
    return done.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def m6_visited_set(spark, folder):
    return ingest.run_to_end(ingest.first_visits(ingest.stream_of(spark, f"{folder}/events.parquet"))).select("user_id", "event_type")


@query("""SELECT url, arg_max(page_id, struct_pack(o := coalesce(epoch_us(observed_at), -4611686018427387904), i := page_id)) AS newest FROM crawled_pages WHERE url IS NOT NULL GROUP BY url""")
def m2_absorbed_newest(spark, folder):
    """The last verdict "current" of each url is its newest observation, whatever the order of arrival."""
    pages = ingest.stream_of(spark, f"{folder}/crawled_pages.parquet").where("url IS NOT NULL")
    rows = pages.select("url", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed"), F.col("page_id").alias("number"))
    verdicts = ingest.run_to_end(ingest.newest_wins(rows)).where("verdict = 'current'")
    known = spark.read.parquet(f"{folder}/crawled_pages.parquet").select(F.col("page_id").alias("number"), F.coalesce(F.unix_micros(F.col("observed_at").cast("timestamp")), F.lit(-(1 << 62))).alias("o"))
    return verdicts.join(known, "number").groupBy("url").agg(F.max_by("number", F.struct("o", "number")).alias("newest"))


@query(f"""WITH told AS (SELECT user_id, list(CASE WHEN event_type = 'error' THEN -1.0 ELSE -2.0 END::double ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id)
SELECT user_id::bigint AS host, list_reduce(list_prepend({ingest.LEAST_PAUSE}::double, kinds), lambda pause, kind: CASE WHEN kind = -1.0 THEN least({ingest.MOST_PAUSE}, pause * 2) ELSE greatest({ingest.LEAST_PAUSE}, pause / 2) END) AS pause,
list_reduce(list_prepend(0.0::double, kinds), lambda failures, kind: CASE WHEN kind = -1.0 THEN failures + 1 ELSE 0.0 END) >= {ingest.PARK_AFTER} AS parked FROM told""")
def m7_host_back_off(spark, folder):
    return ingest.run_to_end(ingest.back_off(ingest.stream_of(spark, f"{folder}/events.parquet")), "update").select("host", "pause", "parked")
