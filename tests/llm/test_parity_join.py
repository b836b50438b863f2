import random
import re

import numpy as np
import pytest

from roamframe.llm.components import components
from roamframe.llm.parity_join import Bands, least_difference, parity_join, part_keys, whole_sketch


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def expected(rows, percent=85):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(shingles(t)), None if i is None else top(i)) for i, t in rows), key=lambda r: [(v is not None, v) for v in r])


def near_copies():
    random.seed(17)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for size in (3, 4, 5, 8, 12, 30, 80, 200, 600):
        for _ in range(4):
            base = [random.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, 2, 3, size // 30, size // 12):
                copy = list(base)
                for _ in range(edits):
                    copy[random.randrange(size)] = random.choice(words)
                rows.append((len(rows), (" " if size % 2 else "\n").join(copy).title()))
    random.shuffle(rows)
    return rows


def test_matches_all_pairs(documents, rows_of, odd):
    rows = [*[(i + 20, t) for i, t in near_copies()], *odd]
    assert rows_of(parity_join(documents(rows)), "doc_id", "n_shingles", "component_id") == expected(rows)


def test_lower_threshold_and_chain(documents, rows_of):
    words = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(60)]
    got = parity_join(documents(rows), percent=80)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == expected(rows, 80)


def test_empty_table(documents):
    assert parity_join(documents([])).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = np.unique(rng.choice(pool, 300)), np.unique(rng.choice(pool, int(rng.integers(1, 500))))
        assert least_difference(whole_sketch(a), whole_sketch(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_sets_share_a_part(percent):
    bands, rng = Bands(percent), np.random.default_rng(4)
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 13, 40, 100, 333, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, int((100 - percent) / 200 * 1.1 * len(a))) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            h, borders = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            home = bands.of(np.diff(borders))
            keys = [set(), set()]
            for band in (home, home - 1):
                k, row = part_keys(h, borders, band, bands)
                for x, r in zip(k.tolist(), row.tolist()):
                    keys[r].add(x)
                # A row shows one part more than linked sets can differ in, and no more.
                shown = np.bincount(row, minlength=2)
                use = band >= 0
                assert (shown[use] == (bands.parts - bands.spare)[band[use]]).all()
            assert keys[0] & keys[1]


def test_unlike_texts_rarely_meet():
    """Sets of one size without a common shingle have no part in common at all."""
    for percent in (80, 85):
        bands, rng = Bands(percent), np.random.default_rng(7)
        sets = [np.sort(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in rng.integers(20, 60, 400)]
        borders = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        home = bands.of(np.diff(borders))
        for band in (home, home - 1):
            keys, row = part_keys(np.concatenate(sets), borders, band, bands)
            assert len(np.unique(keys)) == len(keys)


def test_components(spark):
    random.seed(9)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}
    for a, b in links:
        parent.setdefault(a, a), parent.setdefault(b, b)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: top(i) for a, b in links if a != b for i in (a, b)}


def test_stars_in_small_blocks(documents, rows_of, monkeypatch):
    from roamframe.llm import parity_join as module

    monkeypatch.setattr(module, "STAR_BLOCK", 3)
    rng = random.Random(5)
    words = [f"v{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(90)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(90)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    assert rows_of(parity_join(documents(rows)), "doc_id", "n_shingles", "component_id") == expected(rows)
