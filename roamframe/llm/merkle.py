"""Merkle manifest of a table, of which only every few levels are kept.

Every row is a leaf. The leaves of a group (here: a language) form one tree over the rows in id order,
and the groups' roots form one more tree. Of each tree the leaves and every ``every``-th level above
them are stored. A proof needs the levels between as well: the nodes under one stored node, at most
2^``every`` of them, are gathered, the missing nodes of that aligned subtree are worked out again, every
gathered node gets its siblings in it, and the nodes are forgotten.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from roamframe.llm.ordering import in_order
from roamframe.ordered import running_sum, step_block, total, with_ordered
from roamframe.storage import saved

#: Levels from one stored level to the next: a subtree has at most 2^6 = 64 gathered nodes.
EVERY = 6
#: A step of a proof: one byte for the place of the sibling (or that there is none), then the sibling.
RIGHT, LEFT, NONE = b"\0", b"\1", b"\2"
_STEP = 33
_ALONE = NONE + bytes(32)


def digest(*parts: bytes) -> bytes:
    """SHA-256 over the digests written as lower-case hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def depth(n: int) -> int:
    """Levels from ``n`` nodes to the one above them all."""
    return max(0, n - 1).bit_length()


def above(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes, then each of the ``levels`` levels over them; a last node without a partner is hashed alone."""
    rows = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        rows.append(nodes)
    return rows


def path_to_top(rows: list[list[bytes]], at: int) -> bytes:
    """The steps of the proof of node ``at`` of the lowest of ``rows``, from bottom to top."""
    steps = []
    for row in rows[:-1]:
        other = at ^ 1
        steps.append((LEFT if other < at else RIGHT) + row[other] if other < len(row) else _ALONE)
        at >>= 1
    return b"".join(steps)


def steps_of(path: bytes) -> list[bytes]:
    return [path[i : i + _STEP] for i in range(0, len(path), _STEP)]


def fold(leaf: bytes, steps: list[bytes]) -> bytes:
    """The root to which a leaf and its proof lead."""
    for step in steps:
        place, other = step[:1], step[1:]
        leaf = digest(leaf) if place == NONE else digest(other, leaf) if place == LEFT else digest(leaf, other)
    return leaf


def proof_digest(steps: list[bytes]) -> bytes:
    return digest(*[s[1:] for s in steps if s[:1] != NONE])


def row_digest(values: list[Column]) -> Column:
    """Digest of a row: each value with its length in UTF-8 bytes before it, a dash for null, so that no two rows read alike."""
    texts = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def _subtrees(nodes: DataFrame, every: int, payload: list[str]) -> DataFrame:
    """One row per aligned subtree of a stored level: tree, n, block and its nodes in order."""
    return nodes.groupBy("tree", "n", F.shiftright("pos", every).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *payload))).alias("kids")
    )


def _each(batch: pa.RecordBatch, names: list[str]):
    """Per row the columns ``names`` and the fields of its ``kids`` as lists."""
    plain = [batch.column(n).to_pylist() for n in names]
    lists = batch.column("kids")
    sizes = lists.value_lengths().to_pylist()
    kids = lists.flatten()
    fields = [kids.field(i).to_pylist() for i in range(kids.type.num_fields)]
    at = 0
    for row, size in zip(zip(*plain), sizes):
        yield row, [f[at : at + size] for f in fields]
        at += size


def stored_levels(leaves: DataFrame, every: int = EVERY) -> list[DataFrame]:
    """The stored levels of all trees: ``leaves`` (tree, n, pos, digest), then each ``every``-th level above.

    ``n`` is the number of nodes of the tree's level. In the last level every tree has its root alone. A
    tree that is done goes on unchanged while others grow.
    """
    schema = "tree bigint, n bigint, pos bigint, digest binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def up(batches):
        for batch in batches:
            rows = [
                (tree, (n - 1 >> every) + 1, block, above(digests, min(every, depth(n)))[-1][0])
                for (tree, n, block), (_, digests, *_) in _each(batch, ["tree", "n", "block"])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, arrow.types)], schema=arrow)

    levels = [leaves]
    widest = leaves.agg(F.max("n")).first()[0] or 1
    while True:
        levels.append(saved(_subtrees(levels[-1].select("tree", "n", "pos", "digest"), every, []).mapInArrow(up, schema), "merkle-level"))
        widest = (widest - 1 >> every) + 1
        if widest == 1:
            return levels


def _down(level: DataFrame, over: DataFrame, every: int, payload: list[str]) -> DataFrame:
    """Proofs of the nodes of a stored level, from those of the level stored over it.

    ``over`` and the result have (tree, pos, path, subroot, root); ``payload`` are columns of ``level`` that
    the result keeps. The nodes between the two levels exist only while their subtree is at hand.
    """
    types = {f.name: f.dataType for f in level.schema.fields}
    schema = StructType.fromDDL("tree bigint, pos bigint, path binary, subroot binary, root binary, digest binary")
    for name in payload:
        schema = schema.add(name, types[name])
    arrow = to_arrow_schema(schema)

    def extract(batches):
        for batch in batches:
            rows = []
            for (tree, n, path, subroot, root), (pos, digests, *carried) in _each(batch, ["tree", "n", "path", "subroot", "root"]):
                tower = above(digests, min(every, depth(n)))
                for i, place in enumerate(pos):
                    rows.append((tree, place, path_to_top(tower, i) + path, subroot, root, digests[i], *[c[i] for c in carried]))
            columns = zip(*rows) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    parents = over.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    return _subtrees(level, every, payload).join(parents, ["tree", "block"]).mapInArrow(extract, schema)


def proofs(leaves: DataFrame, every: int = EVERY, payload: list[str] | None = None) -> DataFrame:
    """A proof per leaf: tree, pos, path, subroot, root, digest and the ``payload`` columns.

    ``leaves`` has (tree, n, pos, digest): trees numbered from 0 without a gap, each with ``n`` leaves at
    ``pos`` 0 to n - 1. The roots of the trees, in order of their numbers, form the tree whose root is ``root``.
    """
    levels = stored_levels(leaves, every)
    subroots = levels[-1].select("tree", "digest")
    trees = subroots.count()
    top = stored_levels(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("pos"), "digest"), every
    )
    found = top[-1].select("tree", "pos", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(top[:-1]):
        found = _down(level, found, every, [])
    # Where the top tree ends, the trees begin: a root of theirs is a leaf of it.
    found = found.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for i in reversed(range(len(levels) - 1)):
        found = _down(levels[i], found, every, (payload or []) if i == 0 else [])
    return found


def numbered_leaves(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(tree, n, pos) added to ``rows``: groups in order of their UTF-8 bytes, null first; rows by ``order`` (nulls first), then digest."""
    key = F.col(group).cast("string")
    keyed = rows.withColumn(
        "_group", F.when(key.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), key.cast("binary")))
    ).drop(group)
    placed = saved(in_order(keyed, ["_group"], [order, "digest"]).withColumnRenamed("name", "tree"), "leaves")
    # Counted in blocks of places: a join by tree alone would send the largest group to one task.
    counted = with_ordered(
        placed.withColumn("_one", F.lit(1).cast("long")),
        ["tree"],
        ["place"],
        step_block("place"),
        {"pos": running_sum("_one"), "n": total("_one")},
    )
    return counted.withColumn("pos", F.col("pos") - 1).drop("place", "_one")


def manifest_check(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text), and what folding each row's proof gives.

    One row per row: doc_id, leaf, subroot, root, proof_sha256 (of the siblings up to the root, in order),
    folded_root and verified. Rows whose id's crc32 is divisible by 7 are read with one added to n_chars,
    to see the proof fail; a null n_chars, or a null id, changes nothing. A null lang is a tree of its own,
    the first. Rows with one id go by their digests; rows alike in all five columns are leaves of their
    own, with equal digests and proofs of their own places. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").alias("_lang"),
        row_digest(columns).alias("digest"),
        F.when(tampered & F.col("n_chars").isNotNull(), row_digest([*columns[:3], more, columns[4]])).alias("seen"),
    )
    found = proofs(numbered_leaves(rows, "_lang", "doc_id"), every, ["doc_id", "seen"])
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def check(batches):
        for batch in batches:
            rows = []
            for i, leaf, seen, path, subroot, root in zip(
                *[batch.column(c).to_pylist() for c in ("doc_id", "digest", "seen", "path", "subroot", "root")]
            ):
                steps = steps_of(path)
                led = fold(leaf if seen is None else seen, steps)
                rows.append((i, leaf.hex(), subroot.hex(), root.hex(), proof_digest(steps).hex(), led.hex(), led == root))
            columns = zip(*rows) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return found.mapInArrow(check, schema)
