import random
from hashlib import sha256

import numpy as np
import pytest

from roamframe.llm import suffixes
from roamframe.llm.suffixes import LENGTH, repeated_intervals, without_repeats


def expected(rows):
    """By the set of all runs and the least (id, start) of each; every row is judged by its own text."""
    last = 1 << 63
    least = {}
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - LENGTH + 1):
            place = (last if i is None else i, s)
            run = data[s : s + LENGTH]
            least[run] = min(place, least.get(run, place))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        cover = np.zeros(len(data) + 1, dtype=bool)
        for s in range(len(data) - LENGTH + 1):
            if least[data[s : s + LENGTH]] < (last if i is None else i, s):
                cover[s : s + LENGTH] = True
        cover = cover[: len(data)]
        spans = int((cover & ~np.concatenate([[False], cover])[: len(data)]).sum())
        kept = np.frombuffer(data, dtype=np.uint8)[~cover].tobytes()
        out.append((i, len(data), int(cover.sum()), spans, sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def sample(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(40) for _ in range(5)] + ["x" * 130, "ab" * 90, text(60)[:LENGTH], text(60)[: LENGTH - 1]]
    rows = []
    for i in range(n):
        parts = [rng.choice([text(rng.randint(0, 30)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 30) :]]) for _ in range(rng.randint(1, 5))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    rows += [(200 + i, rows[rng.randrange(n)][1]) for i in range(15)]
    for i in range(15):
        copy = list(rows[rng.randrange(n)][1])
        if copy:
            copy[rng.randrange(len(copy))] = "Q"
        rows.append((300 + i, "".join(copy)))
    rng.shuffle(rows)
    return rows


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_runs(documents, rows_of, seed):
    rows = sample(seed)
    assert rows_of(without_repeats(documents(rows)), *COLUMNS) == expected(rows)


def test_odd_rows(documents, rows_of, odd):
    rows = [*odd, (None, "p" * 300), (10, "x" * 250), (11, "pq" * 80)]
    assert rows_of(without_repeats(documents(rows)), *COLUMNS) == expected(rows)


@pytest.mark.parametrize("together", [2, 100_000])
def test_unrelated_texts_under_one_id_stay(documents, rows_of, monkeypatch, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(180)
    rows = [(1, passage), (None, passage + "x"), (None, text(200)), (5, text(220)), (5, "y" + passage), (5, text(90) + passage)]
    rows += [(None, "head" + passage), (5, rows[3][1]), (6, rows[2][1])]
    got = rows_of(without_repeats(documents(rows)), *COLUMNS)
    assert got == expected(rows)
    assert sum(r[2] == 0 for r in got) == 4


def test_crowded_cores_give_the_same(documents, rows_of, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 2)
    rows = sample(3)
    assert rows_of(without_repeats(documents(rows)), *COLUMNS) == expected(rows)


def test_empty_table(documents):
    assert without_repeats(documents([])).count() == 0


def test_refinement_finds_repeated_suffixes():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) + b"c" * rng.choice([0, 110]) + bytes(rng.choice(b"ab") for _ in range(160)) for _ in range(20)]
    strings += [s[rng.randint(0, 9) :] for s in strings[:7]]
    borders = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    data = b"".join(strings)
    suffix, interval = repeated_intervals(np.frombuffer(data, dtype=np.uint8), borders)
    runs = {}
    for a, b in zip(borders, borders[1:]):
        for i in range(a, b - LENGTH + 1):
            runs.setdefault(data[i : i + LENGTH], []).append(i)
    got = {}
    for s, k in zip(suffix.tolist(), interval.tolist()):
        got.setdefault(k, []).append(s)
    assert sorted(sorted(v) for v in got.values()) == sorted(v for v in runs.values() if len(v) > 1)
