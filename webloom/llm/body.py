"""Main bodies: the lines of crawled pages and crawl results that are not frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import pages as page_facts
from webloom.llm.frames import FrameReader, Learned, Wrappers, extra, learn, stream_places
from webloom.llm.lines import title_keys
from webloom.llm.near import bodies
from webloom.llm.pages import crawled
from webloom.llm.sizes import chunks

#: tab of a stream: which table it is from.
RESULTS, PAGES = 0, 1


def _frame_lines(wrappers: Wrappers):
    """Places of frame lines, from line streams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FrameReader(wrappers)
        for batch in batches:
            masks = reader.masks(batch, stream_places(batch), batch.column("title_key").to_pylist())
            counts = np.array([sum(m) for m in masks], dtype=np.int64)
            places = [at for m in masks for at, framed in enumerate(m) if framed]
            tabs, ids = (np.repeat(np.asarray(batch.column(c)), counts) for c in ("tab", "record_id"))
            yield pa.RecordBatch.from_arrays([pa.array(tabs, pa.int8()), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], names=["tab", "record_id", "line_no"])

    return rows


def _main_text(wrappers: Wrappers):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FrameReader(wrappers)
        for whole in batches:
            for batch in chunks(whole, "text"):
                lines, masks = reader(batch, title_keys(batch.column("title").to_pylist()))
                raw = lines.raw.to_pylist()
                texts = [
                    None if text is None else "\n".join(raw[c] for c, f in zip(lines.of(i).tolist(), masks[i]) if not f)
                    for i, text in enumerate(batch.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(texts, pa.string())], names=["record_id", "body"])

    return rows


def _both(results: DataFrame, crawl: DataFrame) -> tuple[DataFrame, DataFrame, Learned]:
    columns = ("tab", "record_id", "host_key", "title", "text")
    first = bodies(results).withColumn("tab", F.lit(RESULTS)).withColumn("title", F.lit(None).cast("string"))
    second = crawled(crawl).withColumn("tab", F.lit(PAGES))
    return first, second, learn(first.select(*columns).unionAll(second.select(*columns)))


def frame_lines(results: DataFrame, crawl: DataFrame) -> DataFrame:
    """tab, record_id, line_no of every non-empty line that is not main body.

    Pages of keywords and pages of template residue have no main body and are left out.
    Null and empty texts have no lines; a row stored twice is judged twice, alike.
    """
    _, second, learned = _both(results, crawl)
    facts = page_facts.page_facts(learned.on(second), learned.wrappers)
    out = page_facts.residue_pages(facts).union(page_facts.spam_pages(facts)).distinct().select(F.lit(PAGES).cast("byte").alias("tab"), F.col("page_id").alias("record_id"))
    read = learned.on(learned.streams)
    found = read.select("tab", "record_id", "host_key", "title_key", "keys", "kinds", "pattern_at", "pattern", *extra(read)).mapInArrow(
        _frame_lines(learned.wrappers), "tab byte, record_id long, line_no int"
    )
    name = F.when(F.col("tab") == RESULTS, "crawl_results").otherwise("crawled_pages")
    return found.join(out, ["tab", "record_id"], "left_anti").select(name.alias("tab"), "record_id", "line_no")


def main_bodies(results: DataFrame, crawl: DataFrame) -> DataFrame:
    """tab, record_id and body: the lines of the main body in their order (null for a null text)."""
    first, second, learned = _both(results, crawl)

    def of(df: DataFrame, name: str) -> DataFrame:
        read = learned.on(df.select("record_id", "host_key", "title", "text"))
        return read.mapInArrow(_main_text(learned.wrappers), "record_id long, body string").select(F.lit(name).alias("tab"), "record_id", "body")

    return of(first, "crawl_results").unionAll(of(second, "crawled_pages"))


def wrapper_parts(results: DataFrame, crawl: DataFrame) -> DataFrame:
    """host_key, place, key, seen, slotted, slots, head: the parts of each site's wrapper in order."""
    return _both(results, crawl)[2].parts
