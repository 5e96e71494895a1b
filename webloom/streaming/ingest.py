"""Structured Streaming: windows, newest-wins state, host back-off and batch absorption."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.session import checkpoint_dir

#: Back-off bounds of a host in seconds; it is parked after that many failures in a row.
LEAST_PAUSE, MOST_PAUSE, PARK_AFTER = 1.0, 900.0, 5


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream of micro-batches."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"  # a source of one file has to be named by a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", absorb: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Everything the stream gives until its source is used up, from files in the shared folder.

    In complete mode each batch replaces the result; a batch that is run again after a
    failure overwrites its own folder, so nothing is stored twice.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        if absorb:
            absorb(batch, number)
        place = f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}"
        batch.write.mode("overwrite").parquet(place)

    running = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(store).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts per event-time window and type; rows later than the watermark are dropped in append mode."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def first_visits(events: DataFrame) -> DataFrame:
    """Each user and type once: the visited set of a run."""
    return events.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


def _in_order(batches: Iterator[pd.DataFrame], order: list[str], *more: str) -> list[pd.DataFrame]:
    """The rows of a key in one micro-batch as one frame in order: they come in several chunks, and a chunk alone is no order."""
    parts = [batch[[*order, *more]] for batch in batches]
    return [pd.concat(parts, ignore_index=True).sort_values(order, kind="stable")] if parts else []


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get if state.exists else (None, None)
    out = []
    for batch in _in_order(batches, ["observed", "number"]):
        for observed, number in batch.itertuples(index=False):
            entry = (None if pd.isna(observed) else int(observed), int(number))
            old = (seen[0] if seen[0] is not None else -(1 << 62), seen[1] if seen[1] is not None else -1)
            new = (entry[0] if entry[0] is not None else -(1 << 62), entry[1])
            verdict = "current" if new > old else "duplicate" if new == old else "superseded"
            out.append((key[0], entry[1], verdict))
            if verdict == "current":
                seen = entry
    state.update(seen)
    yield pd.DataFrame(out, columns=["url", "number", "verdict"])


def newest_wins(observations: DataFrame) -> DataFrame:
    """url, number and verdict of each observation (url, observed, number) against what was seen of its url."""
    return observations.groupBy("url").applyInPandasWithState(_newest, "url string, number long, verdict string", "observed long, number long", "append", GroupStateTimeout.NoTimeout)


def _back_off(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pause, failures = state.get if state.exists else (LEAST_PAUSE, 0)
    rows = 0
    for batch in _in_order(batches, ["ts", "event_id"], "event_type"):
        for kind in batch["event_type"]:
            rows += 1
            if kind == "error":
                pause, failures = min(MOST_PAUSE, pause * 2), failures + 1
            else:
                pause, failures = max(LEAST_PAUSE, pause / 2), 0
    state.update((pause, failures))
    yield pd.DataFrame([(int(key[0]), rows, pause, failures >= PARK_AFTER)], columns=["host", "rows", "pause", "parked"])


def back_off(events: DataFrame) -> DataFrame:
    """Pause of each host after its outcomes in order: doubled by a failure, halved by a success."""
    return events.groupBy("user_id").applyInPandasWithState(_back_off, "host long, rows long, pause double, parked boolean", "pause double, failures int", "update", GroupStateTimeout.NoTimeout)
