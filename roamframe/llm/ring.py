"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes lie on a ring of 2^63 places. A key belongs to the shard of the first virtual
node clockwise. A shard takes its keys in ring order up to its capacity; keys over it go on clockwise
to the next shard with room. The capacities add up to the number of rows, so counts differ by one at
most. What a shard takes is a range of places on the ring: the walk works on counts per arc, of which
there are as many as virtual nodes, and the rows find their shard by their place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import text_or_empty
from roamframe.llm.ordering import in_order

VIRTUAL_NODES = 128


def ring_nodes(shards: list[int], virtual: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order."""
    nodes = []
    for shard in shards:
        for i in range(virtual):
            place = int.from_bytes(hashlib.sha256(f"{shard}/{i}".encode()).digest()[:8], "big") >> 1
            nodes.append((place, shard))
    return sorted(nodes)


def bounded_walk(counts: list[int], owners: list[int], capacity: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(arc, first, count, shard) of every range of keys, from the counts per arc in ring order.

    Own keys come first, in ring order; then each arc's overflow walks on clockwise.
    """
    room = dict(capacity)
    taken, over = [], []
    for arc, (n, shard) in enumerate(zip(counts, owners)):
        own = min(n, room[shard])
        room[shard] -= own
        if own:
            taken.append((arc, 0, own, shard))
        if n > own:
            over.append((arc, own, n - own))
    for arc, first, n in over:
        for step in range(1, len(owners) + 1):
            shard = owners[(arc + step) % len(owners)]
            part = min(n, room[shard])
            if part:
                taken.append((arc, first, part, shard))
                room[shard] -= part
                first, n = first + part, n - part
            if not n:
                break
    return taken


def ring_shards(docs: DataFrame, shards: int = 8, virtual: int = VIRTUAL_NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of any two shards differ by one at most. size is the text's bytes plus 1
    (null: 1); ``slot`` numbers the rows of a shard from 0 without a gap, in the order in which the shard
    takes them. Rows that repeat an id lie at one place of the ring and are ordered by their checksum. A
    null id has a place too. Other columns are ignored. An empty table gives an empty result.
    """
    nodes = ring_nodes(list(range(shards)), virtual)
    places = np.array([p for p, _ in nodes], dtype=np.int64)
    owners = [s for _, s in nodes]
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("at", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("null"))).bitwiseAND((1 << 63) - 1))

    def arcs(batches):
        """The arc of a key: the first virtual node at or after it, else the first of all."""
        for batch in batches:
            at = batch.column("at").to_numpy()
            arc = np.searchsorted(places, at) % len(places)
            # Past the last node the ring closes: these keys come after all others of arc 0.
            turn = np.where(at > places[-1], len(places), arc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_id", "size", "text_crc32", "at")] + [pa.array(turn.astype(np.int64))],
                ["_id", "size", "text_crc32", "at", "turn"],
            )

    dealt = rows.mapInArrow(arcs, "_id bigint, size bigint, text_crc32 bigint, at bigint, turn bigint")
    placed = in_order(dealt.withColumn("by", F.col("at")), ["at"], ["_id", "text_crc32", "size"]).drop("name")
    # One count per arc: as many as virtual nodes, whatever the input.
    found = {r.turn: r.n for r in placed.groupBy("turn").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(nodes) + 1)]
    total = sum(counts)
    capacity = {s: total // shards + (s < total % shards) for s in range(shards)}
    starts = np.concatenate([[0], np.cumsum(counts)])
    filled = dict.fromkeys(range(shards), 0)
    ranges = []
    for turn, first, n, shard in bounded_walk(counts, [*owners, owners[0]], capacity):
        ranges.append((int(starts[turn] + first), shard, filled[shard]))
        filled[shard] += n
    ranges.sort()
    begin = np.array([r[0] for r in ranges], dtype=np.int64)
    to = np.array([r[1] for r in ranges], dtype=np.int32)
    base = np.array([r[2] for r in ranges], dtype=np.int64)

    def assign(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            k = np.searchsorted(begin, place, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_id", "size", "text_crc32")] + [pa.array(to[k]), pa.array(base[k] + place - begin[k])],
                ["_id", "size", "text_crc32", "shard", "slot"],
            )

    out = placed.select("_id", "size", "text_crc32", "place").mapInArrow(assign, "_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint")
    return out.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
