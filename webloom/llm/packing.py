"""Containers of fixed capacity, filled by minimum bin slack.

A container starts with the longest item left; a bitset dynamic programme over the lengths
that are available then finds the fullest combination for the rest of its room, which is
taken away. Items are dealt over groups by a hash, so that no task sees more than about
GROUP items; containers with more slack than ROUND_SLACK are opened again and their items
dealt anew over fewer groups, until one group holds the rest.

An item longer than the capacity is cut into full containers and a rest that is packed like
any other item. Items without tokens need no container. Ties are broken by doc_id, equal
rows are packed each. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import cut

GROUP = 6_000
ROUND_SLACK = 0.01
ROUNDS = 4


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum comes closest to room without passing it.

    lengths: (length, how many) in the order in which they are tried.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length, many in lengths:
        if length > room:
            continue
        steps.append((length, many, reach))
        left, chunk = min(many, room // length), 1
        while left:
            take = min(chunk, left)
            reach |= (reach << (length * take)) & full
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    out = []
    for length, many, before in reversed(steps):
        if not target:
            break
        times = 0
        while not (before >> target) & 1:
            target -= length
            times += 1
        if times:
            out.append((length, times))
    return out


def pack(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[list[tuple[int, int, int]], int]]:
    """Containers of (tokens, doc_id, piece), each with its fill."""
    shelf: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for item in sorted(items, key=lambda x: (x[0], -x[1], -x[2])):
        shelf[item[0]].append(item)
    order = sorted(shelf, reverse=True)
    out = []
    while order:
        longest = order[0]
        bin_items = [shelf[longest].pop()]
        chosen = fullest([(length, len(shelf[length])) for length in order if shelf[length]], capacity - longest)
        for length, times in chosen:
            bin_items += [shelf[length].pop() for _ in range(times)]
        out.append((bin_items, sum(i[0] for i in bin_items)))
        if any(not shelf[length] for length in {longest, *(c[0] for c in chosen)}):
            order = [length for length in order if shelf[length]]
    return out


PACKED = "capacity_id int, capacity_tokens int, container_id long, doc_id long, piece_no int, piece_tokens int, container_tokens int, open boolean"


def _packer(number: int, last: bool):
    def group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        capacity = table.column("capacity_tokens")[0].as_py()
        items = list(zip(table.column("piece_tokens").to_pylist(), table.column("doc_id").to_pylist(), table.column("piece_no").to_pylist()))
        columns: list[list] = [[] for _ in range(6)]
        base = (number << 56) + (key[1].as_py() << 24)
        for i, (contents, fill) in enumerate(pack(items, capacity)):
            again = not last and capacity - fill > ROUND_SLACK * capacity
            for tokens, doc, piece in contents:
                for column, value in zip(columns, (base + i, doc, piece, tokens, fill, again)):
                    column.append(value)
        n = len(columns[0])
        return pa.table(
            {
                "capacity_id": pa.array([key[0].as_py()] * n, pa.int32()),
                "capacity_tokens": pa.array([capacity] * n, pa.int32()),
                "container_id": pa.array(columns[0], pa.int64()),
                "doc_id": pa.array(columns[1], pa.int64()),
                "piece_no": pa.array(columns[2], pa.int32()),
                "piece_tokens": pa.array(columns[3], pa.int32()),
                "container_tokens": pa.array(columns[4], pa.int32()),
                "open": pa.array(columns[5], pa.bool_()),
            }
        )

    return group


def containers(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_id, capacity_tokens, container_id, doc_id, piece_no, piece_tokens, container_tokens.

    sizes: doc_id and tokens. capacities: capacity_id and capacity_tokens, a short list that
    is checked to be one (at most 1,000 rows).
    """
    known = capacities.select(F.col("capacity_id").cast("int"), F.col("capacity_tokens").cast("int")).where("capacity_tokens > 0").limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1,000 capacities")
    spark = sizes.sparkSession
    room = spark.createDataFrame([(r[0], r[1]) for r in known], "capacity_id int, capacity_tokens int")
    wanted = sizes.where("tokens > 0").crossJoin(F.broadcast(room))
    whole = F.floor(F.col("tokens") / F.col("capacity_tokens"))
    rest = (F.col("tokens") % F.col("capacity_tokens")).cast("int")
    # equal rows are told apart by number, so that each of their pieces fills a container of its own
    longer = wanted.where("tokens >= capacity_tokens").groupBy("capacity_id", "capacity_tokens", "doc_id", "tokens").agg(F.count("*").alias("copies"))
    full = (
        longer.select("capacity_id", "capacity_tokens", "doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select("capacity_id", "capacity_tokens", "doc_id", "tokens", "copy", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece_no"))
        .select(
            "capacity_id",
            "capacity_tokens",
            F.concat_ws("-", F.lit("full"), "doc_id", "tokens", "copy", "piece_no").alias("container_id"),
            "doc_id",
            "piece_no",
            F.col("capacity_tokens").alias("piece_tokens"),
            F.col("capacity_tokens").alias("container_tokens"),
        )
    )
    open_items = cut(wanted.where(rest > 0).select("capacity_id", "capacity_tokens", "doc_id", whole.cast("int").alias("piece_no"), rest.alias("piece_tokens")))
    closed = []
    for number in range(1, ROUNDS + 1):
        most = open_items.groupBy("capacity_id").count().agg(F.max("count")).collect()[0][0] or 0
        if not most:
            break
        groups = max(1, -(-most // GROUP))
        last = groups == 1 or number == ROUNDS
        dealt = open_items.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(number)), F.lit(groups)))
        packed = cut(dealt.groupBy("capacity_id", "deal").applyInArrow(_packer(number, last), PACKED))
        closed.append(packed.where("NOT open").drop("open"))
        open_items = packed.where("open").select("capacity_id", "capacity_tokens", "doc_id", "piece_no", "piece_tokens")
        if last:
            break
    out = full
    for part in closed:
        out = out.unionByName(part.withColumn("container_id", F.col("container_id").cast("string")))
    return out


def fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and the share of room that is used."""
    return packed.groupBy("capacity_id", "capacity_tokens").agg(
        F.countDistinct("container_id").alias("containers"),
        F.sum("piece_tokens").alias("tokens"),
        F.round(F.sum("piece_tokens") / (F.countDistinct("container_id") * F.first("capacity_tokens")), 6).alias("fill"),
    )
