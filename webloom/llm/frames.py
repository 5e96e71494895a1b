"""Page frames by wrapper inference: aligned line streams of each site, and the main body they leave.

1. Streams. A page is read once into the keys of its lines (numbers masked) and of the
   patterns they follow (a label and a slot, a slot and a date, a slot between fixed ends).
2. Tokens. A key that enough pages of a site hold may become a part of its wrapper;
   all other lines can match nothing and are text slots.
3. Alignment. The token streams of a site are aligned one after the other: what meets in
   order is one part, what one side lacks becomes an optional part at that place, and
   title-like slots whose number differs behind a part make it the head of a repeated
   group. Large sites are split over tasks; their partial wrappers are aligned with each
   other in the same way.
4. Reading. A page is aligned with the wrapper of its site; only lines that meet a part,
   in order, and the slots of repeated groups are frame. A line that the site often
   shows, but out of the places where its wrapper has it, stays in the body.

The wrapper of another site reads a page only where at least FOREIGN lines that stand in
that site's wrapper alone are on the page, and more than of its own site: such a page
came with the frame of that site. Otherwise a line frequent on one site stays in the
bodies of all others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.lines import EMPTY, HEADING, PROSE, SHORT, TITLE, VALUE, Lines, Places, title_keys
from webloom.llm.sizes import chunks
from webloom.session import cut

#: What makes a token: this share of the pages of a site that have a body of their own,
#: by the look of the line (or 10 to 12: by its pattern), but LEAST pages in any case.
SHARES = {PROSE: 0.04, TITLE: 0.04, HEADING: 0.04, VALUE: 0.5, SHORT: 0.025, 10: 0.03, 11: 0.06, 12: 0.10}
LEAST = {PROSE: 5, TITLE: 4, HEADING: 6, VALUE: 8, SHORT: 3, 10: 5, 11: 5, 12: 6}
#: A part needs this share of all places in which its token was met, and two pages.
PLACE_SHARE = 0.02
#: Parts up to this number go to every executor as arrays (40 bytes each); beyond it each
#: page gets the wrapper that reads it by joins.
MAX_BROADCAST_PARTS = 1_000_000
#: Columns that such a join adds to the rows.
EXTRA = ("parts", "heads")
#: Pages, and partial wrappers, per task in the alignment.
PAGES_PER_TASK, WRAPPERS_PER_TASK = 4_000, 64
#: Lines of one other site's wrapper alone that make it the reader of a page.
FOREIGN = 2
#: A repeated group follows its head in at least this share of the head's places,
#: with at least this many slots on average.
GROUP_SHARE, GROUP_SLOTS = 0.5, 1.45

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def site_of(url: Column) -> Column:
    """Host in lower case, without port and without one leading www."""
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1)
    return F.when(host == "", F.lit(None)).otherwise(F.regexp_replace(F.lower(host), r"^www\.", ""))


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def of_site(host: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One key for a key of a site."""
    with np.errstate(over="ignore"):
        x = (key.view(np.uint64) ^ (host.view(np.uint64) * _PRIME)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


# -- step 1: streams ----------------------------------------------------------------

STREAM = "tab byte, record_id long, host_key long, title_key long, body boolean, keys array<long>, kinds array<byte>, pattern_at array<int>, pattern array<long>"


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _stream_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            lines = Lines(batch.column("text"))
            places = lines.places()
            page = places.page
            longs = np.flatnonzero(lines.longs[lines.codes])
            pairs = np.unique(np.stack([page[longs], lines.codes[longs]], axis=1), axis=0)[:, 0] if len(longs) else longs
            body = np.bincount(pairs, minlength=len(lines)) >= 2
            row, column = np.nonzero(places.patterns)
            found = np.bincount(page[row], minlength=len(lines))
            at = (row - places.offsets[:-1][page[row]]) * 3 + column
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tab"),
                    batch.column("record_id"),
                    batch.column("host_key"),
                    pa.array(title_keys(batch.column("title").to_pylist()), pa.int64()),
                    pa.array(body),
                    _lists(places.offsets, places.keys, pa.int64()),
                    _lists(places.offsets, places.kinds, pa.int8()),
                    _lists(np.r_[0, np.cumsum(found)], at.astype(np.int32), pa.int32()),
                    _lists(np.r_[0, np.cumsum(found)], places.patterns[row, column], pa.int64()),
                ],
                names=["tab", "record_id", "host_key", "title_key", "body", "keys", "kinds", "pattern_at", "pattern"],
            )


def streams(pages: DataFrame) -> DataFrame:
    """Line streams of pages(record_id, host_key, title, text, and tab where there is one), kept in the shared folder."""
    tab = F.col("tab").cast("byte") if "tab" in pages.columns else F.lit(0).cast("byte")
    return cut(pages.select(tab.alias("tab"), "record_id", "host_key", "title", "text").mapInArrow(_stream_rows, STREAM))


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)].astype(np.int64)


def stream_places(batch: pa.RecordBatch | pa.Table) -> Places:
    """Streams as places again."""
    keys, offsets = _flat(batch.column("keys"))
    kinds, _ = _flat(batch.column("kinds"))
    at, found = _flat(batch.column("pattern_at"))
    patterns = np.zeros((len(keys), 3), dtype=np.int64)
    begin = np.repeat(offsets[:-1], np.diff(found))
    patterns[begin + at // 3, at % 3] = _flat(batch.column("pattern"))[0]
    return Places(offsets, keys, kinds, patterns)


# -- step 2: tokens -----------------------------------------------------------------


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch.column("body"))
        if not batch.num_rows:
            continue
        places = stream_places(batch)
        hosts = batch.column("host_key").to_numpy(zero_copy_only=False)
        page = places.page
        keep = places.kinds != EMPTY
        rows = [np.stack([page[keep], places.kinds[keep].astype(np.int64), places.keys[keep]], axis=1)]
        for place in range(3):
            held = np.flatnonzero(places.patterns[:, place])
            rows.append(np.stack([page[held], np.full(len(held), 10 + place), places.patterns[held, place]], axis=1))
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0], rows[:, 1]))]
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]] if len(rows) else rows
        host, kind, key = hosts[rows[:, 0]], rows[:, 1], rows[:, 2]
        order = np.lexsort((key, kind, host))
        host, kind, key = host[order], kind[order], key[order]
        first = np.flatnonzero(np.r_[True, (host[1:] != host[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
        sites, pages = np.unique(hosts, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[sites, host[first]]),
                pa.array(np.r_[np.full(len(sites), -1), kind[first]].astype(np.int8)),
                pa.array(np.r_[np.zeros(len(sites), np.int64), key[first]]),
                pa.array(np.r_[pages, np.diff(np.r_[first, len(host)])].astype(np.int64)),
            ],
            names=["host_key", "kind", "key", "pages"],
        )


def key_counts(read: DataFrame) -> DataFrame:
    """Pages per site and key, over the pages that have a body; kind -1 holds the pages of the site."""
    return (
        read.select("host_key", "body", "keys", "kinds", "pattern_at", "pattern")
        .mapInArrow(_count_keys, "host_key long, kind byte, key long, pages long")
        .groupBy("host_key", "kind", "key")
        .agg(F.sum("pages").alias("pages"))
        .where((F.col("kind") == -1) | (F.col("pages") >= min(LEAST.values())))
    )


def tokens_of(counted: DataFrame) -> DataFrame:
    """host_key and key of the lines and patterns that may become parts."""
    share = F.create_map(*[F.lit(x) for k, v in SHARES.items() for x in (int(k), float(v))])
    least = F.create_map(*[F.lit(x) for k, v in LEAST.items() for x in (int(k), int(v))])
    site = counted.where("kind = -1").select("host_key", F.col("pages").alias("site_pages"))
    kind = F.col("kind").cast("int")
    return counted.where("kind >= 0").join(site, "host_key").where((F.col("pages") >= least[kind]) & (F.col("pages") >= share[kind] * F.col("site_pages"))).select("host_key", "key").distinct()


# -- step 3: alignment --------------------------------------------------------------


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k] = v
            ends[k] = i
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def meets(tokens: list[int], places: dict[int, list[int]]) -> list[int]:
    """For each token the part that it meets, or -1: as many as can meet in order.

    places: for each token its parts, the last first, so that a token meets one of them.
    """
    out = [-1] * len(tokens)
    last, straight = -1, True
    for i, token in enumerate(tokens):
        at = places.get(token)
        if at is None:
            continue
        if len(at) > 1 or at[0] <= last:
            straight = False
            break
        out[i] = last = at[0]
    if straight:
        return out
    owner = [i for i, token in enumerate(tokens) for _ in places.get(token, ())]
    part = [p for token in tokens for p in places.get(token, ())]
    out = [-1] * len(tokens)
    for k in _increasing(part):
        out[owner[k]] = part[k]
    return out


def places_of(parts: list[int]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for i in range(len(parts) - 1, -1, -1):
        places.setdefault(parts[i], []).append(i)
    return places


class Wrapper:
    """A site's expression so far: its parts in order, each with what was seen of it.

    parts: keys; seen: for each part [pages, pages with slots behind it, those slots].
    """

    def __init__(self) -> None:
        self.parts: list[int] = []
        self.seen: list[list[int]] = []
        self.places: dict[int, list[int]] = {}

    def align(self, tokens: list[int], stats: list[tuple[int, int, int]]) -> None:
        """Take in one stream (or another wrapper): parts that meet are one, others are new and optional."""
        added: list[tuple[int, int, list[int]]] = []
        last = -1
        for token, part, seen in zip(tokens, meets(tokens, self.places), stats):
            if part < 0:
                added.append((last + 1, token, list(seen)))
            else:
                last = part
                have = self.seen[part]
                have[0] += seen[0]
                have[1] += seen[1]
                have[2] += seen[2]
        if added:
            for shift, (at, token, seen) in enumerate(added):
                self.parts.insert(at + shift, token)
                self.seen.insert(at + shift, seen)
            self.places = places_of(self.parts)


def page_tokens(kinds: list[int], anchors: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Tokens of a page in order, and how many title-like slots follow each at once."""
    tokens: list[int] = []
    runs: list[int] = []
    open_run = False
    for kind, anchor in zip(kinds, anchors):
        if anchor:
            tokens.append(anchor)
            runs.append(0)
            open_run = True
        elif kind == EMPTY:
            if open_run and runs[-1]:
                open_run = False
        elif open_run and kind == TITLE:
            runs[-1] += 1
        else:
            open_run = False
    return tuple(tokens), tuple(runs)


def _anchors(places: Places, known) -> np.ndarray:
    """For each line the token that it is, by itself or else by its patterns, or 0. known: tells which keys are tokens."""
    found = np.where(known(places.keys, None), places.keys, 0)
    for column in range(3):
        rest = np.flatnonzero((found == 0) & (places.patterns[:, column] != 0))
        keys = places.patterns[rest, column]
        found[rest] = np.where(known(keys, rest), keys, 0)
    found[places.kinds == EMPTY] = 0
    return found


PARTIAL = "host_key long, salt long, parts array<long>, seen array<long>, slotted array<long>, slots array<long>"


def _partial(host: int, salt: int, wrapper: Wrapper) -> pa.Table:
    seen = wrapper.seen
    lists = [wrapper.parts, *([s[k] for s in seen] for k in range(3))]
    columns = [pa.array([host], pa.int64()), pa.array([salt], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in lists]]
    return pa.table(dict(zip(("host_key", "salt", "parts", "seen", "slotted", "slots"), columns)))


def _align_pages(key: tuple[pa.Scalar, ...], pages: pa.Table, tokens: pa.Table) -> pa.Table:
    wrapper = Wrapper()
    host, salt = (k.as_py() for k in key)
    if pages.num_rows and tokens.num_rows:
        known = np.unique(tokens.column("key").to_numpy())
        places = stream_places(pages)
        anchors, kinds, at = _anchors(places, lambda keys, _: within(keys, known)).tolist(), places.kinds.tolist(), places.offsets.tolist()
        different: dict[tuple, int] = defaultdict(int)
        for i in range(len(places)):
            different[page_tokens(kinds[at[i] : at[i + 1]], anchors[at[i] : at[i + 1]])] += 1
        # the most usual streams first, whatever order the pages came in
        for (stream, runs), n in sorted(different.items(), key=lambda x: (-x[1], -len(x[0][0]), x[0])):
            wrapper.align(list(stream), [(n, n if r else 0, n * r) for r in runs])
    return _partial(host, salt, wrapper)


def _align_wrappers(key: tuple[pa.Scalar, ...], partial: pa.Table) -> pa.Table:
    wrapper = Wrapper()
    rows = sorted(partial.to_pylist(), key=lambda r: (-sum(r["seen"]), r["parts"]))
    for r in rows:
        wrapper.align(r["parts"], list(zip(r["seen"], r["slotted"], r["slots"])))
    return _partial(key[0].as_py(), key[1].as_py(), wrapper)


def wrappers(read: DataFrame, counted: DataFrame) -> DataFrame:
    """host_key, place, key, seen, slotted and slots of each part of each site's wrapper, in order of place."""
    large = counted.where((F.col("kind") == -1) & (F.col("pages") > PAGES_PER_TASK)).select("host_key", F.ceil(F.col("pages") / PAGES_PER_TASK).alias("tasks"))
    tasks = F.coalesce("tasks", F.lit(1))
    pages = read.where("body").join(large, "host_key", "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), tasks)).select("host_key", "salt", "keys", "kinds", "pattern_at", "pattern")
    tokens = tokens_of(counted).join(large, "host_key", "left").select("host_key", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("salt"), "key")
    parts = pages.groupBy("host_key", "salt").cogroup(tokens.groupBy("host_key", "salt")).applyInArrow(_align_pages, PARTIAL)
    most = large.agg(F.max("tasks")).first()[0] or 1
    while most > 1:
        parts = parts.withColumn("salt", F.floor(F.col("salt") / WRAPPERS_PER_TASK)).groupBy("host_key", "salt").applyInArrow(_align_wrappers, PARTIAL)
        most = -(-most // WRAPPERS_PER_TASK)
    flat = parts.select("host_key", F.posexplode(F.arrays_zip("parts", "seen", "slotted", "slots")).alias("place", "part")).select("host_key", "place", F.col("part.parts").alias("key"), "part.seen", "part.slotted", "part.slots")
    whole = flat.groupBy("host_key", "key").agg(F.sum("seen").alias("all_seen"))
    return flat.join(whole, ["host_key", "key"]).where((F.col("seen") >= 2) & (F.col("seen") >= PLACE_SHARE * F.col("all_seen"))).drop("all_seen")


def repeated_groups(parts: DataFrame) -> DataFrame:
    """Keys that head a repeated group, by all places of all sites whose wrappers have them."""
    return (
        parts.groupBy("key")
        .agg(*[F.sum(c).alias(c) for c in ("seen", "slotted", "slots")])
        .where((F.col("seen") >= 4) & (F.col("slotted") >= GROUP_SHARE * F.col("seen")) & (F.col("slots") >= GROUP_SLOTS * F.col("slotted")))
        .select("key", F.lit(True).alias("head"))
    )


def with_heads(parts: DataFrame) -> DataFrame:
    """parts with head: does the part head a repeated group?"""
    return parts.join(repeated_groups(parts), "key", "left").withColumn("head", F.coalesce("head", F.lit(False)))


def signatures(parts: DataFrame) -> DataFrame:
    """key and owner (a host_key): parts that stand in the wrapper of one site alone."""
    return parts.groupBy("key").agg(F.min("host_key").alias("owner"), F.max("host_key").alias("other")).where("owner = other").select("key", "owner")


# -- step 4: reading ----------------------------------------------------------------


@dataclass
class Wrappers:
    """Wrappers of all sites as arrays: site i has the parts from begins[i] to begins[i + 1]."""

    sites: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    signs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(host: np.ndarray, place: np.ndarray, key: np.ndarray, head: np.ndarray) -> Wrappers:
        order = np.lexsort((place, host))
        host, key, head = host[order], key[order], head[order]
        sites, begins = np.unique(host, return_index=True)
        pairs = np.unique(np.stack([key, host], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        keys, first, n = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        return Wrappers(sites, np.r_[begins, len(host)], key, head, np.unique(of_site(host, key)), keys[n == 1], pairs[first[n == 1], 1])

    def readers(self, places: Places, hosts: np.ndarray) -> np.ndarray:
        """For each page the site whose wrapper reads it."""
        out = hosts.copy()
        page = places.page
        if not len(self.signs):
            return out
        at = np.searchsorted(self.signs, places.keys)
        at[at == len(self.signs)] = 0
        hit = np.flatnonzero(self.signs[at] == places.keys)
        held = np.unique(np.stack([page[hit], at[hit]], axis=1), axis=0)
        votes, n = np.unique(np.stack([held[:, 0], self.owners[held[:, 1]]], axis=1), axis=0, return_counts=True) if len(held) else (held, held[:, 0])
        best: dict[int, tuple[int, int]] = {}
        own: dict[int, int] = {}
        for (i, owner), k in zip(votes.tolist(), n.tolist()):
            if owner == hosts[i]:
                own[i] = k
            elif (k, owner) > best.get(i, (0, 0)):
                best[i] = (k, owner)
        for i, (k, owner) in best.items():
            if k >= FOREIGN and k > own.get(i, 0):
                out[i] = owner
        return out

    def of_site(self, host: int) -> tuple[dict[int, list[int]], np.ndarray]:
        i = int(np.searchsorted(self.sites, host))
        if i == len(self.sites) or self.sites[i] != host:
            return {}, np.zeros(0, bool)
        begin, end = self.begins[i], self.begins[i + 1]
        return places_of(self.parts[begin:end].tolist()), self.heads[begin:end]


def frame_mask(kinds: list[int], keys: list[int], anchors: list[int], places: dict[int, list[int]], heads: np.ndarray, title: int = 0) -> list[bool]:
    """For each line of a page: does it belong to the frame? title: key of the page's own title."""
    out = [False] * len(kinds)
    at = [i for i, a in enumerate(anchors) if a]
    if not at:
        return out
    for i, part in zip(at, meets([anchors[i] for i in at], places)):
        if part < 0:
            continue
        out[i] = True
        if heads[part]:
            filled = False
            for k in range(i + 1, len(kinds)):
                if kinds[k] == EMPTY:
                    if filled:
                        break
                elif anchors[k] or kinds[k] != TITLE or (title and keys[k] == title):
                    break
                else:
                    out[k] = filled = True
    return out


class FrameReader:
    """Reads batches of pages by the wrappers of their sites."""

    def __init__(self, wrappers: Wrappers):
        self.wrappers = wrappers
        self.sites: dict[int, tuple[dict[int, list[int]], np.ndarray]] = {}

    def masks(self, batch: pa.RecordBatch, places: Places, titles: list[int] | None = None) -> list[list[bool]]:
        """Frame or not, for each line of each page. batch: has host_key, or the parts that were joined."""
        known = self.wrappers.known
        page = places.page
        if "parts" in batch.schema.names:
            hosts = np.arange(len(places))
            parts, begins = _flat(batch.column("parts"))
            heads, _ = _flat(batch.column("heads"))
            sites = {i: (places_of(parts[begins[i] : begins[i + 1]].tolist()), heads[begins[i] : begins[i + 1]]) for i in range(len(places))}
            known = np.unique(of_site(np.repeat(hosts, np.diff(begins)), parts)) if len(parts) else known[:0]
        else:
            hosts = self.wrappers.readers(places, batch.column("host_key").to_numpy(zero_copy_only=False))
            sites = self.sites
            for host in set(hosts.tolist()) - sites.keys():
                sites[host] = self.wrappers.of_site(host)
        host_of = hosts[page]
        anchors = _anchors(places, lambda keys, rows: within(of_site(host_of if rows is None else host_of[rows], keys), known)).tolist()
        kinds, keys, at = places.kinds.tolist(), places.keys.tolist(), places.offsets.tolist()
        out = []
        for i, host in enumerate(hosts.tolist()):
            a, b = at[i], at[i + 1]
            out.append(frame_mask(kinds[a:b], keys[a:b], anchors[a:b], *sites[host], titles[i] if titles else 0))
        return out

    def __call__(self, batch: pa.RecordBatch, titles: list[int] | None = None) -> tuple[Lines, list[list[bool]]]:
        lines = Lines(batch.column("text"))
        return lines, self.masks(batch, lines.places(), titles)


def extra(df: DataFrame) -> list[str]:
    return [c for c in EXTRA if c in df.columns]


def _text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            lines = Lines(batch.column("text"))
            keys = [np.unique(lines.keys[lines.of(i)]) for i in range(len(lines))]
            owner = np.repeat(np.asarray(batch.column("text_key")), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(keys) if keys else [], pa.int64())], names=["text_key", "key"])


def _stream_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, begins = _flat(batch.column("keys"))
        keys = [np.unique(values[a:b]) for a, b in zip(begins[:-1], begins[1:])]
        owner = np.repeat(np.asarray(batch.column("text_key")), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(keys) if keys else [], pa.int64())], names=["text_key", "key"])


@dataclass
class Learned:
    """Wrappers for the executors, or, beyond the bound, joined from their parts."""

    wrappers: Wrappers
    streams: DataFrame
    parts: DataFrame
    joined: bool = False

    def on(self, df: DataFrame) -> DataFrame:
        """df(host_key, text or keys, ...), with the wrapper that reads each row as columns where wrappers are too many to broadcast."""
        if not self.joined:
            return df
        held, rows = ("keys", _stream_keys) if "keys" in df.columns else ("text", _text_keys)
        keyed = df.drop(*EXTRA).withColumn("text_key", F.xxhash64(held))
        keys = keyed.select("text_key", held).dropDuplicates(["text_key"]).mapInArrow(rows, "text_key long, key long")
        votes = keys.join(signatures(self.parts), "key").groupBy("text_key", "owner").agg(F.count("*").alias("n")).groupBy("text_key").agg(F.collect_list(F.struct("n", "owner")).alias("votes"))
        own = F.coalesce(F.array_max(F.transform(F.filter("votes", lambda v: v["owner"] == F.col("host_key")), lambda v: v["n"])), F.lit(0))
        best = F.array_max(F.filter("votes", lambda v: v["owner"] != F.col("host_key")))
        read = keyed.join(votes, "text_key", "left").withColumn("reader", F.when((best["n"] >= FOREIGN) & (best["n"] > own), best["owner"]).otherwise(F.col("host_key"))).drop("votes", "text_key")
        ordered = self.parts.groupBy("host_key").agg(F.array_sort(F.collect_list(F.struct("place", "key", "head"))).alias("all"))
        one = ordered.select(F.col("host_key").alias("reader"), F.col("all.key").alias("parts"), F.col("all.head").alias("heads"))
        return read.join(one, "reader", "left").drop("reader")


def learn(pages: DataFrame) -> Learned:
    """Wrappers of all sites of pages(record_id, host_key, title, text)."""
    read = streams(pages)
    counted = cut(key_counts(read))
    parts = cut(with_heads(wrappers(read, counted)).select("host_key", "place", "key", "seen", "slotted", "slots", "head"))
    if parts.count() > MAX_BROADCAST_PARTS:
        return Learned(Wrappers(), read, parts, joined=True)
    rows = parts.select("host_key", "place", "key", "head").toArrow()
    return Learned(Wrappers.of(*(rows.column(c).to_numpy() for c in ("host_key", "place", "key", "head"))), read, parts)
