"""N-gram Jaccard join on parity sketches.

A document's set is hashed into a sketch of bits: each shingle flips one bit. Every shingle that only
one of two sets holds changes at most one part of the sketch, so the number of parts that differ is a
lower bound of the symmetric difference. Sets whose sizes lie in one band and that link differ in at
most ``D`` shingles; a sketch of more than ``D`` parts then agrees in some part. Documents that agree
in a part are compared in full.

No pair is made that a component does not need. Of the documents that agree in a part, each is
compared with the first one only. Where these links leave a first document and those that met it in
several components, and only there, all of them are held against each other by their sketches, block
against block inside a task, and the pairs that may link are compared.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import steps, text_or_empty
from roamframe.llm.components import components
from roamframe.llm.words import mixed, shingle_sets, text_bytes
from roamframe.storage import cut, saved

_SALT = np.random.default_rng(20260102).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Parts that a sketch has beyond those that it shows, in hundredths of the bound.
SPARE = 50
#: Members of a star that are held against as many others at a time.
STAR_BLOCK = 1000


class Bands:
    """Size bands: two linked sets lie in one band or in neighbouring ones.

    Band ``i`` compares sets whose sizes start in it with those of it and the next one. ``parts`` is the
    number of parts that its sketches have, ``spare`` how many of them exceed the bound plus one.
    """

    def __init__(self, percent: int, largest: int = 1 << 40) -> None:
        start, bounds = [1, 2], []
        while start[-1] < largest:
            start.append(max(start[-1] + 1, (start[-1] - 1) * 100 // percent + 1))
        for low, high in zip(start, start[1:]):
            total = (high - 1) + (high - 1) * 100 // percent
            # The least intersection of two sets with this sum of sizes.
            common = -(-percent * total // (100 + percent))
            bounds.append(total - 2 * common)
        self.start = np.array(start[:-1], dtype=np.int64)
        bound = np.array(bounds, dtype=np.int64)
        # More parts hold fewer shingles each, but more of the poor ones are left out.
        self.spare = bound * SPARE // 100
        self.parts = bound + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, sizes, side="right") - 1


def part_keys(hashes: np.ndarray, borders: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the sketch parts of each row, as a member of ``band`` (below 0: none).

    A part is the XOR of the whole hashes in it, so equal parts hold the same shingles. A row leaves out
    exactly ``spare`` parts, those that say least: without a shingle, then with the fewest, by an order
    that follows from what a part holds. Two linked rows agree in more parts than that, and the one of
    these that says most is left out by neither.
    """
    sizes = np.diff(borders)
    use = (band >= 0) & (sizes > 0)
    safe = np.where(use, band, 0)
    parts = np.where(use, bands.parts[safe], 0)
    offset = np.concatenate([[0], np.cumsum(parts)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    held = use[row]
    h, row = hashes[held], row[held]
    if not len(h):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    high = np.uint64(32)
    part = (((h >> high) * parts[row].astype(np.uint64)) >> high).astype(np.int64) + offset[row]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    value = np.bitwise_xor.reduceat(h, first)
    count = np.diff(np.concatenate([first, [len(h)]]))
    filled, owner = part[first], row[first]
    per_row = np.bincount(owner, minlength=len(sizes))
    more = np.where(use, bands.spare[safe] - (parts - per_row), 0)
    order = np.lexsort((mixed(value), count, owner))
    place = np.arange(len(order)) - np.concatenate([[0], np.cumsum(per_row)])[owner[order]]
    kept = order[place >= np.maximum(more, 0)[owner[order]]]
    value, row, local = value[kept], owner[kept], filled[kept] - offset[owner[kept]]
    if (more < 0).any():
        # More empty parts than may be left out: of these the last ones count.
        empty = np.ones(offset[-1], dtype=bool)
        empty[filled] = False
        owners = np.repeat(np.arange(len(sizes)), parts)
        lacking = np.flatnonzero(empty & (more < 0)[owners])
        behind = np.cumsum(np.bincount(owners[lacking], minlength=len(sizes)))[owners[lacking]] - np.arange(len(lacking))
        lacking = lacking[behind <= -more[owners[lacking]]]
        value = np.concatenate([value, np.zeros(len(lacking), dtype=np.uint64)])
        row = np.concatenate([row, owners[lacking]])
        local = np.concatenate([local, lacking - offset[owners[lacking]]])
    return mixed(mixed(value) + safe[row].astype(np.uint64) * _SALT[5] + local.astype(np.uint64) * _SALT[6]), row


def _sets(batch, shingle: int):
    """(rows, hashes, borders) of each step of a batch whose second column is the text."""
    column = batch.column(1)
    data, borders = text_bytes(column)
    for a, b in steps(np.diff(borders)):
        own = borders[a : b + 1]
        yield slice(a, b), *shingle_sets(data[own[0] : own[-1]], own - own[0], shingle)


def _buckets(batches):
    """Rows (key, doc) in order give (key, hub, doc, edge): each with the first document of its bucket.

    A bucket of one gives nothing. A partition's first and last rows come as edges too: a bucket that
    goes on in the next partition has a first document in each.
    """
    key, hub, doc = None, None, None

    def rows(k, h, d, edge):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(d), pa.array(np.full(len(k), edge))], ["key", "hub", "doc", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        begins = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        at = np.flatnonzero(begins)
        hubs = np.concatenate([[hub if hub is not None else d[0]], d[at]])[np.cumsum(begins)]
        if key is None:
            yield rows(k[:1], hubs[:1], d[:1], True)
        yield rows(k[~begins], hubs[~begins], d[~begins], False)
        key, hub, doc = k[-1], hubs[-1], d[-1]
    if key is not None:
        yield rows(np.array([key]), np.array([hub]), np.array([doc]), True)


def whole_sketch(hashes: np.ndarray) -> bytes:
    """The set's sketch in one piece: between two and four bits per shingle, a power of two of them."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(one: bytes, other: bytes) -> int:
    """Bits that differ, a lower bound of the symmetric difference; the longer sketch is folded first."""
    x, y = (np.frombuffer(v, dtype=np.uint64) for v in (one, other))
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _bound(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    total = n + m
    return total - 2 * -(-percent * total // (100 + percent))


def _sized(sizes: DataFrame, side: str) -> DataFrame:
    return sizes.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))


def _close(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that their sizes and sketches allow to link."""

    def near(batches):
        for batch in batches:
            most = _bound(*[batch.column(f"n_{s}").to_numpy() for s in ("a", "b")], percent)
            bound = [least_difference(x, y) for x, y in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())]
            keep = pa.array(np.array(bound, dtype=np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    sized = pairs.join(_sized(sizes, "a"), "a").join(_sized(sizes, "b"), "b")
    sized = sized.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return saved(sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(near, "a bigint, b bigint"), "close").distinct()


def _blocks_close(one: list[tuple], other: list[tuple], percent: int):
    """Pairs of documents (doc, component, size, sketch) of two blocks that may link across components."""
    for words in sorted({len(m[3]) for m in one}):
        own = [m for m in one if len(m[3]) == words]
        # Sizes that can link differ by less than two, so sketches are as long, or twice or half as long.
        near = [(*m[:3], m[3] if len(m[3]) <= words else bytes(np.bitwise_xor.reduce(np.frombuffer(m[3], np.uint64).reshape(2, -1), axis=0))) for m in other if len(m[3]) in (words, 2 * words)]
        half = [m for m in other if 2 * len(m[3]) == words]
        for rows, short in ((near, False), (half, True)):
            if not rows:
                continue
            doc, component, size = (np.array([m[i] for m in rows], dtype=np.int64) for i in range(3))
            bits = np.frombuffer(b"".join(m[3] for m in rows), dtype=np.uint64).reshape(len(rows), -1)
            for d, c, n, sketch in own:
                x = np.frombuffer(sketch, dtype=np.uint64)
                x = np.bitwise_xor.reduce(x.reshape(2, -1), axis=0) if short else x
                fits = np.flatnonzero((component != c) & (np.minimum(size, n) * 100 >= np.maximum(size, n) * percent))
                if len(fits):
                    differ = np.bitwise_count(bits[fits] ^ x).sum(axis=1, dtype=np.int64)
                    for k in fits[differ <= _bound(size[fits], np.int64(n), percent)]:
                        yield max(d, int(doc[k])), min(d, int(doc[k]))


def _across(stars: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) inside a star (star, doc, component) that may link and lie in different components.

    A star is cut into blocks of members, and each pair of blocks is a group of its own, however large
    the star. Pairs are looked at by their sketches inside a task; only those that may link become rows.
    """
    count = stars.groupBy("star").agg(F.ceil(F.count("*") / F.lit(STAR_BLOCK)).cast("int").alias("blocks"))
    own = stars.join(cut(count), "star").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    own = own.join(sizes.select("doc", "n", "sketch"), "doc")
    facing = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    dealt = own.select("star", F.explode(facing).alias("f"), "block", "doc", "component", "n", "sketch")
    dealt = dealt.select("star", "f.low", "f.high", "block", "doc", "component", "n", "sketch")
    group = ["star", "low", "high"]

    def look(batches):
        held: dict[int, list[tuple]] = {}
        now = None

        def found():
            if now is None:
                return
            one, other = held.get(now[1], []), held.get(now[2], [])
            out = sorted(set(_blocks_close(one, other, percent)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

        for batch in batches:
            for star, low, high, block, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (star, low, high) != now:
                    yield from found()
                    held, now = {}, (star, low, high)
                held.setdefault(block, []).append(tuple(member))
        yield from found()

    return saved(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(look, "a bigint, b bigint"), "across").distinct()


def _linked(close: DataFrame, rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Of the pairs (a, b), those that link, by their whole sets."""
    # Few documents are left now. Their ids are stored, so that Spark knows their size when it plans the join.
    wanted = saved(close.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    texts = saved(rows.join(wanted, "doc", "left_semi"), "texts")
    text_of = lambda side: texts.select(F.col("doc").alias(side), F.col("text").alias(f"text_{side}"))
    full = close.join(text_of("a"), "a").join(text_of("b"), "b")

    def verify(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            (left, lb), (right, rb) = (text_bytes(batch.column(f"text_{s}")) for s in ("a", "b"))
            for i, j in steps(np.diff(lb) + np.diff(rb)):
                la, ra = lb[i : j + 1], rb[i : j + 1]
                x, xb = shingle_sets(left[la[0] : la[-1]], la - la[0], shingle)
                y, yb = shingle_sets(right[ra[0] : ra[-1]], ra - ra[0], shingle)
                for r in range(j - i):
                    p, q = x[xb[r] : xb[r + 1]], y[yb[r] : yb[r + 1]]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i + r] = common > 0 and 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return cut(full.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint").distinct())


def parity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, A-Z as a-z; a document's set is its distinct
    ``shingle``-word shingles, or its whole sequence where it has fewer words. Two documents link when
    their sets share at least ``percent`` hundredths of their union. component_id is the smallest id
    that links reach. A document without words (or with a null text) has an empty set, links with
    nothing and is its own component. Rows that repeat an id are one node with the links of all of
    them; a null id links with nothing and has a null component. Other columns are ignored. Shingles
    are compared by 64-bit hashes.
    """
    bands = Bands(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))

    def measure(batches):
        for batch in batches:
            n, prints, sketches = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.uint64), []
            for at, h, borders in _sets(batch, shingle):
                n[at] = np.diff(borders)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h * _SALT[7]), dtype=np.uint64)])
                prints[at] = mixed(sums[borders[1:]] - sums[borders[:-1]])
                sketches += [whole_sketch(h[i:j]) for i, j in zip(borders, borders[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(prints.view(np.int64)), pa.array(sketches, pa.binary())], ["doc", "n", "print", "sketch"])

    def sketch(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, h, borders in _sets(batch, shingle):
                home = bands.of(np.diff(borders))
                for band in (home, home - 1):
                    keys, row = part_keys(h, borders, band, bands)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[at][row])], ["key", "doc"])

    sizes = saved(rows.mapInArrow(measure, "doc bigint, n bigint, print bigint, sketch binary"), "sizes")
    # Documents with one set: the first stands for all of them from here on.
    sets = sizes.filter("n > 0 and doc is not null").groupBy("n", "print").agg(F.min("doc").alias("node"), F.max("doc").alias("last"))
    sets = cut(sets.filter("node < last").drop("last"))
    copies = saved(sizes.select("doc", "n", "print").join(sets, ["n", "print"]).filter("doc <> node").select("doc", "node").distinct(), "copies")

    def standing(df, side):
        """``df`` with documents of ``side`` replaced by the one that stands for them."""
        own = copies.select(F.col("doc").alias(side), "node")
        return df.join(own, side, "left").withColumn(side, F.coalesce("node", side)).drop("node")

    known = rows.filter("doc is not null")
    keyed = known.mapInArrow(sketch, "key bigint, doc bigint")
    # Ordered by (key, doc): a bucket of any size is spread over as many partitions as it needs.
    buckets = saved(
        keyed.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc").mapInArrow(
            _buckets, "key bigint, hub bigint, doc bigint, edge boolean"
        ),
        "buckets",
    )
    # Two rows per partition: a bucket that crosses its border has the first document of all its parts.
    edges = buckets.filter("edge").select("key", "hub").distinct()
    begins = cut(edges.groupBy("key").agg(F.min("hub").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    members = buckets.select("key", "doc", "hub").unionByName(edges.join(begins, "key", "left_semi").select("key", F.col("hub").alias("doc"), "hub"))
    members = members.join(begins, "key", "left").select(F.col("doc").alias("a"), F.coalesce("first", "hub").alias("b"))
    first = members.filter("a <> b").distinct()
    first = cut(standing(standing(first, "a"), "b").filter("a <> b").distinct())
    links = _linked(_close(first, sizes, percent), known, percent, shingle)
    found = components(links)

    # Stars, a first document with all that met it in some bucket, that lie in more than one component.
    def placed(df, side, name):
        own = found.select(F.col("node").alias(side), F.col("component").alias(name))
        return df.join(own, side, "left").withColumn(name, F.coalesce(name, side))

    rays = cut(placed(placed(first, "a", "c_a"), "b", "c_b"))
    split = rays.filter("c_a <> c_b").select("b").distinct()
    rays = rays.join(split, "b", "left_semi")
    stars = rays.select(F.col("b").alias("star"), F.col("a").alias("doc"), F.col("c_a").alias("component"))
    stars = cut(stars.unionByName(rays.select(F.col("b").alias("star"), F.col("b").alias("doc"), F.col("c_b").alias("component"))).distinct())
    links = links.unionByName(_linked(_across(stars, sizes, percent), known, percent, shingle))
    found = components(links.unionByName(copies.select(F.col("doc").alias("a"), F.col("node").alias("b"))))
    return sizes.join(found, sizes.doc == found.node, "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"),
    )
