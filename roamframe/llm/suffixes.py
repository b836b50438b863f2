"""Removal of repeated passages by merging shards' suffixes with interleave refinement.

Which suffixes can share 100 bytes is settled first, without comparing them. Every run of 100 bytes
holds an anchor: the 32-byte run with the smallest hash in it. Equal runs have equal anchors at the same
place, so only surroundings of anchors that occur more than once go on, and each distinct one once.

The shards' suffixes, of all surroundings in a task, are then interleaved. They start in the order of
their first byte. A pass steps from each suffix to the one three bytes before it and deals the suffixes
out by those bytes, which are what stands before them in the Burrows-Wheeler order, while suffixes that
share them keep their order. So every pass makes the order right for three more bytes, no suffix is
sorted anew, and an interval that splits shows how long its common prefix was. Intervals of one suffix
leave. What is left after 100 bytes are the repeated intervals; all but their earliest member go.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import steps, text_or_empty
from roamframe.llm.words import _BYTE, _powers_up_to, mixed, text_bytes
from roamframe.storage import cut, saved

LENGTH, CORE = 100, 32
#: How far a run of LENGTH bytes reaches beyond the core that it holds.
REACH = LENGTH - CORE
#: Bytes before a suffix that one pass takes; 1 + 33 * 3 is LENGTH.
STRIDE = 3
#: Surroundings of one core that are refined together; those of a core with more are compared run by run.
TOGETHER = 100_000
#: Bytes of surroundings that are refined at a time, unless one core has more: few enough for a core's cache.
BATCH_BYTES = 250_000
#: Bytes of text whose anchors are looked for at a time, unless one text is longer.
STEP_BYTES = 400_000
#: A byte of its own value per letter case: cores are compared as they are.
_PLAIN = _BYTE.copy()
_PLAIN[65:91] = mixed(np.arange(65, 91, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = pick(values[done:], values[:-done])
        done *= 2
    left = width - done
    return pick(values[left:], values[:-left]) if left else values


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers_up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_PLAIN[data] * up[: len(data)], out=sums[1:])
    return sums


def anchors(data: np.ndarray, borders: np.ndarray):
    """(core, around, row, place, left, right) of the anchors of texts that lie one after another.

    ``core`` and ``around`` are hashes of the core and of its surroundings, which reach ``left`` and
    ``right`` bytes beyond it: REACH, or as far as the text does.
    """
    none = np.zeros(0, dtype=np.int64)
    long = np.flatnonzero(np.diff(borders) >= LENGTH)
    if not len(long):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    _, down = _powers_up_to(len(data) + 1)
    sums = _prefix_sums(data)
    hashes = mixed((sums[CORE:] - sums[:-CORE]) * down[: len(data) - CORE + 1])
    value = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    width = REACH + 1
    least = _slid(value, width, np.minimum)
    # Runs that would leave their text ask for nothing: no value is 0.
    inside = np.zeros(len(least) + 1, dtype=np.int32)
    np.add.at(inside, borders[long], 1)
    np.add.at(inside, np.minimum(borders[long + 1] - LENGTH + 1, len(least)), -1)
    asked = np.zeros(len(least) + 2 * REACH, dtype=np.uint32)
    asked[REACH : REACH + len(least)] = np.where(np.cumsum(inside[:-1]) > 0, least, 0)
    at = np.flatnonzero(_slid(asked, width, np.maximum)[: len(value)] == value)
    row = np.searchsorted(borders, at, side="right") - 1
    low = np.maximum(borders[row], at - REACH)
    high = np.minimum(borders[row + 1], at + CORE + REACH)
    left, right = at - low, high - at - CORE
    shape = (left * 256 + right).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    around = mixed((sums[high] - sums[low]) * down[low] + shape)
    return hashes[at], around, row, at - borders[row], left, right


def _runs(batches):
    """From rows in order of (core, around, doc, at): which repeat whole, and which are to be compared.

    A row repeats whole when an earlier row has the same surroundings. The first row of its surroundings
    is compared when others have its core. At the borders of a partition, where the neighbours are not
    known, rows are compared to be on the safe side.
    """
    names = ["whole", "core", "doc", "at", "print"]
    core = around = doc = at = None
    waiting = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        c, a, d, p, t = (batch.column(i).to_numpy() for i in range(5))
        if core is None:
            new_core = np.concatenate([[True], c[1:] != c[:-1]])
            new = np.concatenate([[True], new_core[1:] | (a[1:] != a[:-1])])
        else:
            new_core = np.concatenate([[c[0] != core], c[1:] != c[:-1]])
            new = new_core | np.concatenate([[a[0] != around], a[1:] != a[:-1]])
        first = np.flatnonzero(new)
        head_doc = np.concatenate([[doc if doc is not None else d[0]], d[first]])[np.cumsum(new)]
        head_at = np.concatenate([[at if at is not None else p[0]], p[first]])[np.cumsum(new)]
        whole = ~new & ((d != head_doc) | (p != head_at))
        # A first row has company when the one before it, or the next first row, has its core.
        company = ~new_core[first]
        if core is None and len(first):
            company[0] = True
        if waiting is not None and len(first):
            if not new_core[first[0]]:
                yield pa.RecordBatch.from_arrays([pa.array([False]), *waiting], names)
            waiting = None
        company[:-1] |= ~new_core[first[1:]]
        take = first[company]
        index = np.concatenate([np.flatnonzero(whole), take])
        if len(first) and not company[-1]:
            waiting = [pa.array(x[first[-1:]]) for x in (c, d, p, t)]
        if len(index):
            kinds = np.zeros(len(index), dtype=bool)
            kinds[: len(index) - len(take)] = True
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *[pa.array(x[index]) for x in (c, d, p, t)]], names)
        core, around, doc, at = c[-1], a[-1], head_doc[-1], head_at[-1]
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array([False]), *waiting], names)


def repeated_intervals(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, interval): the suffixes whose first LENGTH bytes occur again in these strings.

    Suffixes of one interval share these bytes; each suffix is its offset in ``data``.
    """
    n = len(data)
    offset = np.arange(n) - np.repeat(borders[:-1], np.diff(borders))
    before = data.astype(np.uint32)
    gram = np.zeros(n, dtype=np.uint32)
    if n >= STRIDE:
        gram[: n - 2] = (before[:-2] << np.uint32(16)) | (before[1:-1] << np.uint32(8)) | before[2:]
    _, name = np.unique(gram, return_inverse=True)
    # Up to 65,536 names are dealt out by counting.
    name = name.astype(np.uint16 if name.max(initial=0) < 65_536 else np.int64)
    # A suffix that is to end up at a string's start, or after it, begins LENGTH - 1 bytes further on.
    order = np.flatnonzero(offset >= LENGTH - 1).astype(np.int32)
    order = order[np.argsort(data[order], kind="stable")]
    value = data[order]
    split = np.concatenate([[True], value[1:] != value[:-1]]) if len(order) else np.zeros(0, dtype=bool)
    interval = np.cumsum(split, dtype=np.int32)
    for _ in range((LENGTH - 1) // STRIDE):
        if not len(order):
            break
        order = order - np.int32(STRIDE)
        key = name[order]
        deal = np.argsort(key, kind="stable")
        order, key, interval = order[deal], key[deal], interval[deal]
        split = np.concatenate([[True], (key[1:] != key[:-1]) | (interval[1:] != interval[:-1])])
        alone = split & np.concatenate([split[1:], [True]])
        interval = np.cumsum(split, dtype=np.int32)
        order, interval = order[~alone], interval[~alone]
    return order, interval


def _refined(strings: list[bytes], doc: np.ndarray, start: np.ndarray):
    """(string, first, size) of the stretches of these strings that repeat an earlier one."""
    borders = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    suffix, interval = repeated_intervals(data, borders)
    own = np.searchsorted(borders, suffix, side="right") - 1
    place = start[own] + suffix - borders[own]
    by = np.lexsort((place, doc[own], interval))
    own, place, interval, suffix = own[by], place[by], interval[by], suffix[by]
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.concatenate([[True], interval[1:] != interval[:-1]])
    which = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc[own] != doc[own[which]]) | (place != place[which])
    suffix = np.sort(suffix[later])
    own = np.searchsorted(borders, suffix, side="right") - 1
    begins = np.ones(len(suffix), dtype=bool)
    begins[1:] = (suffix[1:] != suffix[:-1] + 1) | (own[1:] != own[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.append(first[1:], len(suffix)) - 1
    return own[first], start[own[first]] + suffix[first] - borders[own[first]], suffix[last] - suffix[first] + LENGTH


def _compared(batches):
    """Marks from rows in order of core: whole cores together, few at a time."""
    names = ["doc", "print", "mark"]
    held: list[tuple[bytes, int, int, int]] = []
    size, core = 0, None

    def marks():
        doc, start, texts = (np.array([h[i] for h in held]) for i in (1, 2, 3))
        own, first, length = _refined([h[0] for h in held], doc, start)
        return pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(texts[own]), pa.array(first * 1024 + length)], names)

    for batch in batches:
        for own, doc, start, around, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if own != core and size >= BATCH_BYTES:
                yield marks()
                held, size = [], 0
            held.append((around, doc, start, text))
            size, core = size + len(around), own
    if held:
        yield marks()


def _run_marks(batches):
    """(one, two, doc, start, print) of every run of LENGTH bytes in the surroundings: two hashes and its place."""
    for batch in batches:
        for doc, start, around, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
            digests = [sha256(around[i : i + LENGTH]).digest() for i in range(len(around) - LENGTH + 1)]
            both = np.frombuffer(b"".join(d[:16] for d in digests), dtype=np.int64).reshape(-1, 2)
            n = len(both)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.full(n, doc)), pa.array(start + np.arange(n)), pa.array(np.full(n, text))], ["one", "two", "doc", "start", "print"]
            )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes. A byte goes when a run of 100 bytes over it also starts earlier: in a document
    of smaller id, or earlier in the same one; all is judged on the texts as they come. n_spans counts
    the stretches that go, kept_sha256 is of what stays. Texts under 100 bytes stay whole, a null one
    counts as empty. A run's place is its document's id and its start; null ids come last. Rows that repeat
    an id, and rows without one, are judged each by its own text: of a run in several rows of one id the
    place with the least start stays, in every row that has it there. Other columns are ignored.
    """
    last = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc"), text_or_empty(text_col).alias("text"))
    # An id and a hash of the text name a row: rows that have both in common lose the same bytes.
    rows, row = rows.withColumn("print", F.xxhash64("text")), ["doc", "print"]

    def find(batches):
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, borders = text_bytes(batch.column(1))
            for a, b in steps(np.diff(borders), STEP_BYTES):
                own = borders[a : b + 1]
                core, around, own_row, place, left, right = anchors(data[own[0] : own[-1]], own - own[0])
                # 48 bits tell cores apart well enough: surroundings are compared by their bytes.
                yield pa.RecordBatch.from_arrays(
                    [pa.array((core >> np.uint64(16)).view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids[a + own_row]), pa.array((place << 16) | (left << 8) | right), pa.array(prints[a + own_row])],
                    ["core", "around", "doc", "at", "print"],
                )

    keys = ["core", "around", "doc", "at", "print"]
    found = rows.mapInArrow(find, "core bigint, around bigint, doc bigint, at bigint, print bigint")
    found = found.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = saved(found.mapInArrow(_runs, "whole boolean, core bigint, doc bigint, at bigint, print bigint"), "anchors")

    place, left, right = F.expr("at >> 16"), F.expr("(at >> 8) & 255"), F.expr("at & 255")
    whole = found.filter("whole").select(*row, ((place - left) * 1024 + left + right + CORE).alias("mark"))
    asked = found.filter("not whole").groupBy(*row).agg(F.collect_set(F.struct("core", "at")).alias("asked"))

    def surroundings(batches):
        for batch in batches:
            for doc, text, asked, name in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                out = []
                for a in asked:
                    begin = (a["at"] >> 16) - (a["at"] >> 8 & 255)
                    out.append((a["core"], doc, begin, data[begin : (a["at"] >> 16) + CORE + (a["at"] & 255)], name))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["core", "doc", "start", "around", "print"])

    shapes = "core bigint, doc bigint, start bigint, around binary, print bigint"
    parts = rows.join(asked, row).select("doc", "text", "asked", "print").mapInArrow(surroundings, shapes)
    # Cores with more surroundings than one task should refine.
    crowded = cut(found.filter("not whole").groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select("core"))
    usual, many = parts, None
    if not crowded.isEmpty():
        parts = saved(parts, "surroundings")
        usual, many = parts.join(crowded, "core", "left_anti"), parts.join(crowded, "core", "left_semi")
    marks = usual.repartition("core").sortWithinPartitions("core").mapInArrow(_compared, "doc bigint, print bigint, mark bigint")
    if many is not None:
        runs = saved(many.select("core", "doc", "start", "around", "print").mapInArrow(_run_marks, "one bigint, two bigint, doc bigint, start bigint, print bigint"), "runs")
        heads = cut(runs.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("head")))
        later = runs.join(heads, ["one", "two"]).filter((F.col("doc") != F.col("head.doc")) | (F.col("start") != F.col("head.start")))
        marks = marks.unionByName(later.select(*row, (F.col("start") * 1024 + LENGTH).alias("mark")))
    marks = whole.unionByName(marks).distinct().groupBy(*row).agg(F.collect_list("mark").alias("marks"))

    def removed(batches):
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for text, own in zip(texts, lists):
                data = text.encode()
                n, gone, spans = len(data), 0, 0
                if own:
                    mark = np.array(own, dtype=np.int64)
                    begin = np.minimum(mark >> 10, n)
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, np.minimum(begin + (mark & 1023), n), -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone = int(cover.sum())
                    spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if n else 0
                    data = np.frombuffer(data, dtype=np.uint8)[~cover].tobytes()
                out.append((n, gone, spans, sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    out = rows.join(marks, row, "left").select("doc", "text", "marks")
    out = out.mapInArrow(removed, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.select(F.when(F.col("doc") != last, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
