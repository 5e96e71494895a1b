"""Versions of one text: bodies that share at least 45 in a hundred of their three-word sequences.

1. Bodies (frames.py) with equal sequence sets form a class; only one row of a class goes on.
2. A body's sketch is a ring of SEGMENTS segments of WIDTH minimal hashes over all its
   sequences, common or rare.
3. Pigeonring filter. If two sketches differ in at most LIMIT hashes, some segment begins a
   chain whose first l segments differ in at most l * LIMIT / SEGMENTS, for every l. A pair
   is looked at where it has an equal segment, and the chain of CHAIN segments that
   begins there is checked at once (at LENGTHS), in the join itself, on four bits a hash:
   only pairs that stay within these budgets leave the join.
4. The full Hamming check against LIMIT. Far below it (SURE) a pair is a version beyond
   doubt; for the pairs between, the sequences themselves decide.

Classes, their links and their members are the result (version_groups); version_pairs
expands them to pairs of rows. No row, bucket or partner is capped; a segment that very
many bodies share makes a large join partition, which is split on both sides when the
join runs (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.frames import FrameReader, Learned, Wrappers, extra, learn, site_of
from webloom.llm.lines import EMPTY, key64
from webloom.llm.sizes import chunks
from webloom.operators.graph import components
from webloom.session import cut

SIMILARITY = 0.45
WORDS = 3
SEGMENTS, WIDTH = 44, 3
HASHES = SEGMENTS * WIDTH
#: Hamming limit over the HASHES: what a pair at SIMILARITY differs in (0.55) and 2.7 standard deviations.
LIMIT = 88
#: Up to this many differences a similarity below SIMILARITY is five standard deviations away.
SURE = 44
#: Segments of a chain, the equal one with it.
CHAIN = 16
#: Lengths of a chain at which its budget is checked.
LENGTHS = (4, 6, 8, 10, 13, 16)
#: Up to this number ids go to the executors as a sorted array (8 bytes each); beyond it rows are joined.
MAX_IDS = 1_000_000

_RNG = np.random.default_rng(20240611)
_MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
#: Segments whose bits fill one long, and longs of a chain.
_EACH = 16 // WIDTH
_RINGS = (CHAIN - 1) // _EACH
_NIBBLES = 0x1111111111111111


def bodies(df: DataFrame) -> DataFrame:
    """The columns that are read; rows without url take the site of base_url."""
    site = F.coalesce(site_of(F.col("url")), site_of(F.col("base_url")), F.lit(""))
    return df.select("result_id", F.col("result_id").alias("record_id"), F.xxhash64(site).alias("host_key"), F.col("raw_content").alias("text"))


def _mix(x: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of 64."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return (x >> np.uint64(32)).astype(np.uint32)


def sequences(reader: FrameReader, texts: pa.RecordBatch | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each body's different word sequences, sorted, and where each body's begin."""
    lines, masks = reader(texts)
    framed = np.fromiter((f for m in masks for f in m), dtype=bool, count=len(lines.codes))
    keep = ~framed & (lines.kinds[lines.codes] != EMPTY)
    page = np.repeat(np.arange(len(lines)), np.diff(lines.offsets))[keep]
    codes = lines.codes[keep]
    different, back = np.unique(codes, return_inverse=True)
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(lines.raw.take(pa.array(different)))))
    coded = words.flatten().dictionary_encode()
    hashes = np.fromiter((key64(w) for w in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary)).view(np.uint64)
    flat = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    offsets = np.asarray(words.offsets).astype(np.int64)
    begins, lengths = offsets[:-1][back], np.diff(offsets)[back]
    total = int(lengths.sum())
    at = np.repeat(begins - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total) if total else np.zeros(0, np.int64)
    word, owner = flat[at], np.repeat(page, lengths)
    with np.errstate(over="ignore"):
        joined = (word[:-2] * np.uint64(0x9E3779B97F4A7C15) + word[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + word[2:] if len(word) > 2 else np.zeros(0, np.uint64)
        ok = owner[2:] == owner[:-2] if len(word) > 2 else np.zeros(0, bool)
        value = _mix(joined[ok])
    both = np.sort(owner[2:][ok].astype(np.uint64) << np.uint64(32) | value.astype(np.uint64)) if len(value) else np.zeros(0, np.uint64)
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    starts = np.searchsorted(both, np.arange(len(lines) + 1, dtype=np.uint64) << np.uint64(32))
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), starts


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimal hashes (16 bits each) of the bodies that begin at starts; none of them is empty."""
    sketch = np.empty((len(starts), HASHES), dtype=np.uint16)
    if len(starts):
        hashed = np.empty_like(values)
        for k in range(HASHES):
            np.bitwise_xor(values, _ADD[k], out=hashed)
            np.multiply(hashed, _MULTIPLY[k], out=hashed)
            sketch[:, k] = np.minimum.reduceat(hashed, starts) >> np.uint32(8)
    return sketch


def _stored(sketch: np.ndarray) -> list[bytes]:
    """Low bytes of all hashes, then the high ones."""
    return [row.tobytes() for row in np.concatenate([(sketch & np.uint16(255)).astype(np.uint8), (sketch >> np.uint16(8)).astype(np.uint8)], axis=1)]


def _sketch_rows(wrappers: Wrappers):
    """Rows (result_id, class key, sketch) of the bodies that have text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FrameReader(wrappers)
        schema = pa.schema([("result_id", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("sketch", pa.binary())])
        for whole in batches:
            for batch in chunks(whole, "text"):
                texts = batch.column("text").to_pylist()
                values, starts = sequences(reader, batch)
                have = np.flatnonzero(np.diff(starts))
                stored = dict(zip(have.tolist(), _stored(sketches(values, starts[have]))))
                ids, first, second, drawn = [], [], [], []
                for i, (row, text) in enumerate(zip(batch.column("result_id").to_pylist(), texts)):
                    part = values[starts[i] : starts[i + 1]]
                    if not len(part) and not (text and text.strip()):
                        continue
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(part.tobytes() if len(part) else b"text " + text.encode()), dtype=np.int64)
                    ids.append(row), first.append(int(a)), second.append(int(b)), drawn.append(stored.get(i))
                columns = [pa.array(x, f.type) for x, f in zip((ids, first, second, drawn), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows


def _hashes(column: pa.Array) -> np.ndarray:
    stored = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), 2, HASHES).astype(np.uint16)
    return stored[:, 0] | stored[:, 1] << np.uint16(8)


def ring_postings(sketch: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per body and segment its key, and four bits of each hash of the CHAIN - 1 segments that follow on the ring."""
    parts = sketch.reshape(-1, SEGMENTS, WIDTH).astype(np.uint64)
    shifts = np.arange(WIDTH, dtype=np.uint64)
    keys = (parts << (shifts * np.uint64(16))).sum(axis=2, dtype=np.uint64)
    with np.errstate(over="ignore"):
        keys = (keys ^ (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(29)
    few = ((parts & np.uint64(15)) << (shifts * np.uint64(4))).sum(axis=2, dtype=np.uint64)
    rings = [sum(np.roll(few, -(_EACH * r + j + 1), axis=1) << np.uint64(4 * WIDTH * j) for j in range(_EACH)) for r in range(_RINGS)]
    return keys.view(np.int64), [r.view(np.int64) for r in rings]


def _postings(chosen: Chosen):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = chosen.of(batch)
            keys, rings = ring_postings(_hashes(batch.column("sketch")))
            ids = np.repeat(np.asarray(batch.column("result_id")), SEGMENTS)
            columns = [pa.array(x.ravel(), pa.int64()) for x in (keys, ids, *rings)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", *(f"ring_{r}" for r in range(_RINGS))])

    return rows


def budget(length: int) -> int:
    """Differences that the first `length` segments of a chain may have."""
    return length * LIMIT // SEGMENTS


def chain_holds(rings: list[tuple[Column, Column]]) -> Column:
    """Do the segments behind an equal one stay within the budgets of LENGTHS?

    Few lengths keep the generated join small enough to be compiled.
    """
    within, so_far = F.lit(True), F.lit(0)
    for r, (left, right) in enumerate(rings):
        x = left.bitwiseXOR(right)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(_NIBBLES))
        for j in range(1, _EACH + 1):
            length = _EACH * r + j + 1
            if length in LENGTHS:
                within = within & (so_far + F.bit_count(x.bitwiseAND(F.lit((1 << 4 * WIDTH * j) - 1))) <= budget(length))
        so_far = so_far + F.bit_count(x)
    return within


def _hamming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within LIMIT, and whether they are so near that no further check is needed. Low bytes stand for the hashes."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("low_a", "low_b"))
        differ = (left != right).sum(axis=1)
        near = pa.array(differ <= LIMIT)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(near) for c in ("a", "b")), pa.array(differ <= SURE).filter(near)], names=["a", "b", "sure"])


def _sequence_rows(wrappers: Wrappers, chosen: Chosen):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FrameReader(wrappers)
        for whole in batches:
            for batch in chunks(chosen.of(whole), "text"):
                values, starts = sequences(reader, batch)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("result_id"), lists], names=["result_id", "sequences"])

    return rows


@dataclass
class Chosen:
    """Rows by result_id: a sorted array that a worker applies itself, or a join made before."""

    ids: np.ndarray | None
    keep: bool

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.ids is None:
            return batch
        inside = np.isin(np.asarray(batch.column("result_id")), self.ids, kind="sort")
        return batch.filter(pa.array(inside if self.keep else ~inside))


def _choice(rows: DataFrame, ids: DataFrame, keep: bool) -> tuple[DataFrame, Chosen]:
    """Rows whose result_id is, or is not, among ids. Few ids spare the rows a shuffle and a worker of their own."""
    ids = ids.distinct()
    few = ids.limit(MAX_IDS + 1).toArrow().column("result_id").to_numpy()
    if len(few) <= MAX_IDS:
        return rows, Chosen(np.sort(few), keep)
    return rows.join(ids, "result_id", "left_semi" if keep else "left_anti"), Chosen(None, keep)


@dataclass
class Classes:
    """Bodies and their wrappers, a sketch for each row, and the class of each row that shares its class."""

    texts: DataFrame
    learned: Learned
    rows: DataFrame
    shared: DataFrame


def classes(df: DataFrame) -> Classes:
    read = bodies(df)
    learned = learn(read.withColumn("title", F.lit(None).cast("string")))
    texts = learned.on(read)
    rows = cut(texts.select("result_id", "host_key", "text", *extra(texts)).mapInArrow(_sketch_rows(learned.wrappers), "result_id long, key_a long, key_b long, sketch binary"))
    keys = rows.select("result_id", "key_a", "key_b")
    first = keys.groupBy("key_a", "key_b").agg(F.min("result_id").alias("class_id"), F.count("*").alias("n"))
    shared = keys.join(first.where("n > 1"), ["key_a", "key_b"]).select("result_id", "class_id")
    return Classes(texts, learned, rows, cut(shared))


def candidates(found: Classes) -> DataFrame:
    """Pairs (a, b) of classes whose sketches have an equal segment from which a chain holds."""
    others = found.shared.where("result_id <> class_id").select("result_id")
    singles, chosen = _choice(found.rows.where("sketch IS NOT NULL").select("result_id", "sketch"), others, keep=False)
    rings = [f"ring_{r}" for r in range(_RINGS)]
    postings = singles.mapInArrow(_postings(chosen), "key long, id long, " + ", ".join(f"{r} long" for r in rings))
    left, right = (postings.select("key", F.col("id").alias(side), *[F.col(r).alias(f"{r}_{side}") for r in rings]) for side in ("a", "b"))
    chain = chain_holds([(F.col(f"{r}_a"), F.col(f"{r}_b")) for r in rings])
    return left.join(right, "key").where((F.col("a") < F.col("b")) & chain).select("a", "b").distinct()


def class_pairs(found: Classes) -> DataFrame:
    """Pairs (a, b) of classes, by their least result_id, whose bodies are versions of one text."""
    low = found.rows.where("sketch IS NOT NULL").select("result_id", F.substring("sketch", 1, HASHES).alias("low"))
    drawn = (
        candidates(found)
        .join(low.select(F.col("result_id").alias("a"), F.col("low").alias("low_a")), "a")
        .join(low.select(F.col("result_id").alias("b"), F.col("low").alias("low_b")), "b")
    )
    near = cut(drawn.select("a", "b", "low_a", "low_b").mapInArrow(_hamming, "a long, b long, sure boolean"))
    open_pairs = near.where("not sure").select("a", "b")
    wanted = open_pairs.select(F.col("a").alias("result_id")).union(open_pairs.select("b"))
    texts = found.texts
    paired, chosen = _choice(texts.select("result_id", "host_key", "text", *extra(texts)), wanted, keep=True)
    exact = paired.mapInArrow(_sequence_rows(found.learned.wrappers, chosen), "result_id long, sequences array<int>")
    pairs = open_pairs.join(exact.select(F.col("result_id").alias("a"), F.col("sequences").alias("sa")), "a").join(
        exact.select(F.col("result_id").alias("b"), F.col("sequences").alias("sb")), "b"
    )
    both = F.size(F.array_intersect("sa", "sb"))
    # x / (m + n - x) >= 45 / 100 in whole numbers
    hundredth = int(round(SIMILARITY * 100))
    decided = pairs.withColumn("both", both).where((F.col("both") > 0) & (100 * F.col("both") >= hundredth * (F.size("sa") + F.size("sb") - F.col("both")))).select("a", "b")
    return near.where("sure").select("a", "b").union(decided)


def version_pairs(df: DataFrame) -> DataFrame:
    """All pairs of rows (result_id_a < result_id_b) whose bodies are versions of one text.

    Rows without text are in no pair; rows with equal raw_content always are, even where
    their body has fewer than three words. Extra columns are ignored; an empty table gives
    an empty result.
    """
    found = classes(df)
    pairs, shared = class_pairs(found), found.shared
    inside = shared.select("class_id", F.col("result_id").alias("x")).join(shared.select("class_id", F.col("result_id").alias("y")), "class_id").where("x < y").select("x", "y")
    left = shared.select(F.col("class_id").alias("a"), F.col("result_id").alias("x"))
    right = shared.select(F.col("class_id").alias("b"), F.col("result_id").alias("y"))
    between = pairs.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    return between.union(inside).select(F.least("x", "y").alias("result_id_a"), F.greatest("x", "y").alias("result_id_b"))


def version_groups(df: DataFrame) -> DataFrame:
    """result_id, group_id (the least result_id of its group) and links (rows it is a version of).

    Groups are the connected parts of the version pairs between classes; rows of one class
    share its links. Labels spread along the pairs until none changes.
    """
    found = classes(df)
    pairs, shared = cut(class_pairs(found)), found.shared
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = shared.groupBy(F.col("class_id").alias("b")).agg(F.count("*").alias("rows"))
    labels = components(pairs)
    links = both.join(size, "b", "left").groupBy(F.col("a").alias("class_id")).agg(F.sum(F.coalesce("rows", F.lit(1))).alias("links"))
    rows = df.select("result_id").join(shared, "result_id", "left").select("result_id", F.coalesce("class_id", "result_id").alias("class_id"))
    own = shared.groupBy("class_id").agg((F.count("*") - 1).alias("copies"))
    return (
        rows.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
        .join(links, "class_id", "left")
        .join(own, "class_id", "left")
        .select("result_id", F.coalesce("label", "class_id").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))).cast("long").alias("links"))
    )
