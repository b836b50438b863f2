"""Benchmark decontamination by q-gram lemma filtering.

A window of an item starts at each of its letters. A text region within ``edits`` edits of a window of ``m``
characters shares at least ``m + 1 - q - q * edits`` of its q-grams, and they lie within ``edits``
diagonals of each other. The q-grams that a text shares with an item are counted in overlapping bands
of diagonals; windows that reach the bound in a band are aligned inside it, which settles them exactly.
An item shorter than a window is one window; where no edit is left to it, its letters are compared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import steps, text_or_empty
from roamframe.llm.words import _powers_up_to, mixed

#: Characters of a window and of a q-gram, and the edits allowed in a window.
WINDOW, Q, EDITS = 50, 10, 3
#: Diagonals between band starts; a band spans two of these.
BAND = 8
#: Characters of items that one pass searches for; more items take more passes.
PASS_CHARS = 20_000_000
#: Shared q-grams, counted per item, that are looked at together, and windows aligned together.
TOGETHER, ALIGNED = 2_000_000, 4096
_FILTER_BITS = 24
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_OUTSIDE = np.uint32(0xFFFFFFFF)
_SPACE = np.uint32(32)
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its lower-case letter, or a space for all but letters and digits; and a random value."""
    if not _tables:
        n = 0x20000
        small = [chr(c) for c in range(n)]
        _tables.append(np.array([ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else ord(c) if c.isalnum() else 32 for c in small], dtype=np.uint32))
        _tables.append(mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return _tables[0], _tables[1]


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, place, borders): the texts' lower-case letters and digits, other runs as one space.

    ``place`` is each letter's code point offset in its own text.
    """
    table, _ = _letters()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    low = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points)
    blank = low == _SPACE
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = own[:-1][own[:-1] < own[1:]]
    keep[starts] = True
    at = np.flatnonzero(keep)
    borders = np.searchsorted(at, own)
    return low[at], at - np.repeat(own[:-1], np.diff(borders)), borders


def gram_hashes(letters: np.ndarray, q: int) -> np.ndarray:
    """A hash per run of ``q`` letters; runs that cross texts are for the caller to leave out."""
    _, table = _letters()
    n = len(letters)
    if n < q:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers_up_to(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    value = table[np.minimum(letters, len(table) - 1)]
    far = letters >= len(table)
    if far.any():
        value[far] = mixed(letters[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    np.cumsum(value * up[:n], out=sums[1:])
    return mixed((sums[q:] - sums[:-q]) * down[: n - q + 1])


@dataclass
class Items:
    """Items of one pass: their letters, q-grams in order of hash, and the items of fewer letters than a q-gram."""

    ids: np.ndarray
    letters: np.ndarray
    borders: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    gram_item: np.ndarray
    gram_place: np.ndarray
    gram_key: np.ndarray
    bitmap: np.ndarray
    tiny: dict[bytes, list[int]]


def indexed(rows: list[tuple[int, str]]) -> Items:
    """Items begin and end with a letter or digit: what stands before and after is left out."""
    letters, _, borders = letters_of([_EDGES.sub("", t) for _, t in rows])
    hashes = gram_hashes(letters, Q)
    item = np.repeat(np.arange(len(rows)), np.diff(borders))
    inside = item[: len(hashes)] == item[Q - 1 :] if len(hashes) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(inside)
    # The first q-gram leads to an item that is compared letter by letter.
    at = at[(allowed(np.diff(borders)[item[at]]) > 0) | (at == borders[item[at]])]
    at = at[np.argsort(hashes[at], kind="stable")]
    grams, first = np.unique(hashes[at], return_index=True)
    bitmap = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bitmap[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    own = item[at]
    tiny: dict[bytes, list[int]] = {}
    for i in np.flatnonzero((np.diff(borders) > 0) & (np.diff(borders) < Q)):
        tiny.setdefault(letters[borders[i] : borders[i + 1]].tobytes(), []).append(int(i))
    ids = np.array([i for i, _ in rows], dtype=np.int64)
    first = np.append(first, len(at))
    key = np.repeat(np.arange(len(grams)), np.diff(first)) * np.int64(len(rows)) + own
    return Items(ids, letters, borders, grams, first, own, at - borders[own], key, bitmap, tiny)


def allowed(size):
    """Edits allowed in a window of this size: in proportion, and none where a q-gram might not survive one."""
    return np.where(np.asarray(size) < 2 * Q, 0, EDITS * np.minimum(size, WINDOW) // WINDOW)


def aligned(pattern: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Least edits of each pattern against any stretch of its text inside the band.

    ``text[:, i + k]`` faces ``pattern[:, i]`` on diagonal ``k`` of ``width``.
    """
    n, m = pattern.shape
    cost = np.zeros((n, width), dtype=np.int32)
    ramp = np.arange(width, dtype=np.int32)
    for i in range(m):
        step = cost + (text[:, i : i + width] != pattern[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
    return cost.min(axis=1)


def _bound(size):
    """The q-gram lemma: how many q-grams a window of this size shares with whatever matches it."""
    return size + 1 - Q - Q * allowed(size)


def matches(texts: list[str], items: Items) -> tuple[np.ndarray, ...]:
    """(row, item, edits, start, end) of each window found in a text; start and end in code points."""
    letters, place, borders = letters_of(texts)
    found = [_tiny(letters, borders, items)]
    hashes = gram_hashes(letters, Q)
    if len(hashes) and len(items.grams):
        at = np.flatnonzero(items.bitmap[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(items.grams, hashes[at]), len(items.grams) - 1)
        real = items.grams[slot] == hashes[at]
        at, slot = at[real], slot[real]
        row = np.searchsorted(borders, at, side="right") - 1
        inside = at + Q <= borders[row + 1]
        found += _shared(letters, borders, at[inside], row[inside], slot[inside], items, 0, len(items.ids))
    row, item, cost, start, stop = (np.concatenate(c) for c in zip(*found))
    return row, item, cost, place[start], place[stop - 1] + 1


def _tiny(letters, borders, items: Items) -> tuple[np.ndarray, ...]:
    """Texts that are an item of fewer letters than a q-gram, and nothing else."""
    hits = []
    for row in np.flatnonzero(np.diff(borders) < Q + 2) if items.tiny else ():
        a, b = borders[row], borders[row + 1]
        while a < b and letters[a] == _SPACE:
            a += 1
        while a < b and letters[b - 1] == _SPACE:
            b -= 1
        hits += [(row, i, 0, a, b) for i in items.tiny.get(letters[a:b].tobytes(), ())]
    return tuple(np.array(hits, dtype=np.int64).reshape(-1, 5).T)


def _shared(letters, borders, at, row, slot, items: Items, low: int, high: int) -> list[tuple[np.ndarray, ...]]:
    """Matches with the items from ``low`` to ``high`` by the q-grams of the text that they hold.

    A q-gram may stand at many places of many items. Where that makes too many to look at together, half of
    the items are taken after the other.
    """
    if not len(at):
        return []
    begin, end = items.first[slot], items.first[slot + 1]
    if (low, high) != (0, len(items.ids)):
        # Places of a q-gram are in order of items.
        begin = np.searchsorted(items.gram_key, slot * np.int64(len(items.ids)) + low)
        end = np.searchsorted(items.gram_key, slot * np.int64(len(items.ids)) + high)
    times = end - begin
    if times.sum() > TOGETHER and high - low > 1:
        some, half = times > 0, (low + high) // 2
        at, row, slot = at[some], row[some], slot[some]
        return _shared(letters, borders, at, row, slot, items, low, half) + _shared(letters, borders, at, row, slot, items, half, high)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    use = np.repeat(begin, times) + nth
    at, row = np.repeat(at, times), np.repeat(row, times)
    item, gram = items.gram_item[use], items.gram_place[use]
    plain = allowed(np.diff(items.borders)[item]) == 0
    return [
        _compared(letters, borders, at[plain], row[plain], item[plain], items),
        *_in_bands(letters, borders, at[~plain], row[~plain], item[~plain], gram[~plain], items),
    ]


def _compared(letters, borders, at, row, item, items: Items) -> tuple[np.ndarray, ...]:
    """Items without an edit to spare that stand in the text as whole words, from ``at`` on."""
    size = np.diff(items.borders)[item]
    stop = at + size
    padded = np.append(letters, _SPACE)
    keep = stop <= borders[row + 1]
    keep &= (at == borders[row]) | (padded[at - 1] == _SPACE)
    keep &= (stop >= borders[row + 1]) | (padded[np.minimum(stop, len(letters))] == _SPACE)
    for i in range(2 * Q):
        inside = np.flatnonzero(keep & (i < size))
        keep[inside] = letters[at[inside] + i] == items.letters[items.borders[item[inside]] + i]
    return row[keep], item[keep], np.zeros(keep.sum(), dtype=np.int64), at[keep], stop[keep]


def _in_bands(letters, borders, at, row, item, gram, items: Items):
    """Windows whose q-grams reach the bound in a band of diagonals, settled by alignment, a number at a time."""
    diagonal = (at - borders[row]) - gram
    # Each hit counts in two bands, so hits within BAND diagonals of each other share one.
    reach = np.int64(1 << 32)
    band = np.concatenate([diagonal // BAND, diagonal // BAND - 1])
    row, item, gram, at = (np.concatenate([x, x]) for x in (row, item, gram, at))
    group = (row * np.int64(len(items.ids)) + item) * reach + (band + (1 << 31))
    order = np.lexsort((gram, group))
    group, row, item, gram, at, band = (x[order] for x in (group, row, item, gram, at, band))
    if not len(group):
        return
    # Groups by number; the key orders hits by group and place in the item.
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    key = number * reach + gram
    once = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own, place = number[once], gram[once]
    length = np.diff(items.borders)[item[once]]
    size = np.minimum(length, WINDOW)
    bound = _bound(size)
    # As many q-grams as the bound, from one hit on, lie in the windows that start from ``low`` to ``high``.
    last = np.minimum(np.arange(len(once)) + bound - 1, len(once) - 1)
    low = np.maximum(place[last] - (size - Q), 0)
    high = np.minimum(place, length - size)
    some = np.flatnonzero((np.arange(len(once)) + bound <= len(once)) & (own[last] == own) & (low <= high))
    if not len(some):
        return
    own, low, high, size, hit = own[some], low[some], high[some], size[some], once[some]
    # Both ends grow from hit to hit, so each window is taken with the first hit that leads to it.
    low[1:] = np.where(own[1:] == own[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
    times = np.maximum(high - low + 1, 0)
    done = np.cumsum(times)
    for first in range(0, done[-1], ALIGNED):
        nth = np.arange(first, min(first + ALIGNED, done[-1]))
        of = np.searchsorted(done, nth, side="right")
        starts = low[of] + nth - (done[of] - times[of])
        for m in np.unique(size[of]):
            these = size[of] == m
            h, s = hit[of[these]], starts[these]
            cost = _cost(letters, borders, row[h], item[h], band[h], s, int(m), items)
            keep = cost <= allowed(m)
            if keep.any():
                h, s, cost = h[keep], s[keep], cost[keep]
                base = number[h] * reach + s
                ends = np.stack([np.searchsorted(key, base), np.searchsorted(key, base + m - Q + 1)], axis=1).ravel()
                held = np.append(at, at[-1])
                begin, end = np.minimum.reduceat(held, ends)[::2], np.maximum.reduceat(held, ends)[::2] + Q
                yield row[h], item[h], cost, begin, end


def _cost(letters, borders, row, item, band, starts, m, items: Items) -> np.ndarray:
    """Least edits of each window of ``m`` letters inside its band of the text."""
    width = 2 * BAND + 2 * EDITS
    pattern = items.letters[(items.borders[item] + starts)[:, None] + np.arange(m)]
    index = (borders[row] + starts + band * BAND - EDITS)[:, None] + np.arange(m + width)
    text = letters[np.clip(index, 0, len(letters) - 1)]
    text[(index < borders[row][:, None]) | (index >= borders[row + 1][:, None])] = _OUTSIDE
    return aligned(pattern, text, width).astype(np.int64)


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items in passes of about PASS_CHARS characters; items without an id are in none."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).filter("id is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = total // PASS_CHARS + 1
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).orderBy("id", "text").collect()
        if rows:
            yield indexed([(r.id, r.text) for r in rows])


def _steps(texts: list[str]):
    for a, b in steps([len(t) for t in texts]):
        yield a, texts[a:b]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, item_id, n_windows, least_edits, start, end of every document and item that match.

    A document matches an item when, among letters and digits in lower case with all else as single
    spaces, it holds any 50 characters of the item that follow each other with at most 3 edits. A shorter item counts
    as a whole: with in proportion fewer edits from 20 characters on, as it stands and as whole words from 10 on;
    one of fewer is matched by a document that says nothing else. n_windows counts the places in the document
    at which matching windows begin; start and end (code points, end exclusive) span the
    matching windows. Null and empty texts and items
    match nothing; a repeated item id matches under that id; repeated rows count together. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = "_id bigint, item_id bigint, edits bigint, start bigint, stop bigint"
    found = spark.createDataFrame([], schema)
    for items in passes(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def search(batches, shared=shared):
            for batch in batches:
                ids = batch.column(0)
                for a, texts in _steps(batch.column(1).to_pylist()):
                    row, item, edits, start, stop = matches(texts, shared.value)
                    if len(row):
                        own = ids.take(pa.array(a + row))
                        yield pa.RecordBatch.from_arrays([own, *map(pa.array, (shared.value.ids[item], edits, start, stop))], ["_id", "item_id", "edits", "start", "stop"])

        found = found.unionByName(rows.mapInArrow(search, schema))
    return (
        found.groupBy("_id", "item_id")
        .agg(F.count_distinct("start").alias("n_windows"), F.min("edits").alias("least_edits"), F.min("start").alias("start"), F.max("stop").alias("end"))
        .withColumnRenamed("_id", id_col)
    )


def without_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item. Nothing is shuffled."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for items in passes(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def clean(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, texts in _steps([t or "" for t in batch.column(at).to_pylist()]):
                    keep[a + matches(texts, shared.value)[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
