import hashlib
import random
import re
import zlib
from itertools import groupby, product

import pytest

import roamframe.llm.repair as module
from roamframe.llm.repair import ROOT, Trail, cheapest, damaged, damaged_and_repaired, less, repair, with_row

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, place string, mark string, kind string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", None, "c") for r in rows], SCHEMA)


def key(row):
    return [(v is not None, v) for v in row]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def best_audit(rows):
    """(cost, audit, repaired lines) by the cheapest way from each place to the end; the least letter among equals."""
    n = len(rows)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = [dict() for _ in range(n + 1)]
    for i in reversed(range(n + 1)):
        ways = {q: [] for q in after}
        for q in after:
            if i == n:
                if q in ("", "a"):
                    ways[q].append((0, "", []))
                continue
            role, text, fault = rows[i]
            ways[q].append((3, "D", [], i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == after[q] or (role[:1] == "s" and q == ""):
                    ways[q].append((0 + more, "K", [f"{role}:{text}"], i + 1, role[:1]))
                name = {"u": "user", "a": "assistant"}[after[q]]
                ways[q].append((2 + more, "R", [f"{name}:{text}"], i + 1, after[q]))
        done = {}
        for q in after:
            options = [w if len(w) == 3 else (w[0] + best[w[3]][w[4]][0], w[1] + best[w[3]][w[4]][1], w[2] + best[w[3]][w[4]][2]) for w in ways[q] if len(w) == 3 or w[4] in best[w[3]]]
            if options:
                done[q] = min(options, key=lambda w: w[:2])
        for _ in range(3):
            for q in after:
                to = after[q]
                if to in done:
                    name = {"u": "user:", "a": "assistant:"}[to]
                    way = (done[to][0] + 2, "I" + done[to][1], [name, *done[to][2]])
                    if q not in done or way[:2] < done[q][:2]:
                        done[q] = way
        best[i] = done
    return best[0][""]


def expected(rows, ids=()):
    mark = lambda r, x: sha(f"{len(r.encode())}:{r}{x}")
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, mark(r[2], r[3])))
    out = {i: (i, 0, 0, 0, 0, 0, 0, "", sha("")) for i in ids}
    for conv, own in groupby(rows, key=lambda r: r[0]):
        own, seen, judged = list(own), set(), []
        for _, _, role, text in own:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        count = lambda f: sum(j[2] == f for j in judged)
        cost, audit, lines = best_audit(judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(lines)))
    return sorted(out.values(), key=key)


def conversations(seed, n=50, longest=14):
    random.seed(seed)
    rows = []
    for conv in range(n):
        for t in range(random.randint(1, longest)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sam"])
            text = random.choice([f"Yes {t}.", f"No {conv}!", "cut", "ok?  ", " \x0b\r", "", None, "same.", "a\nb.", "é😀", "[.!?]"])
            rows.append((conv, random.choice([t, t, t, t + 3, None]), role, text))
    return rows


ODD = [
    (None, 0, "assistant", "null id."),
    (None, None, "user", "null turn."),
    (700, None, "user", "only null turns."),
    (701, 5, "system", "alone."),
    (702, 1, "user", "again."),
    (702, 1, "user", "again."),
    (703, 2, "user", "long. " * 40_000),
    (703, 9, "assistant", "😀" * 20_000),
]


@pytest.mark.parametrize("block", [3, 2048])
def test_repair_of_random_and_odd_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rows = [*conversations(block), *ODD, *[(800, t, "assistant", f"{t}.") for t in range(60)]]
    got = [tuple(r[c] for c in COLUMNS) for r in repair(table(spark, rows)).collect()]
    assert sorted(got, key=key) == expected(rows)


def test_damage_then_repair(spark):
    rows = [*conversations(11, 120), *ODD]
    df = table(spark, rows)
    plain = sorted(damaged_rows(rows), key=key)
    assert sorted([tuple(r) for r in damaged(df).collect()], key=key) == plain
    got = [tuple(r[c] for c in COLUMNS) for r in damaged_and_repaired(df).collect()]
    assert sorted(got, key=key) == expected(plain, {r[0] for r in rows})


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = damaged_and_repaired(table(spark, [(gone, 0, "user", "x.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert damaged_and_repaired(table(spark, [])).count() == 0
    assert repair(table(spark, [])).count() == 0


def states_of(rows):
    states = {0: (0, ROOT)}
    for initial, fault in rows:
        states = with_row(states, initial, fault)
    cost, trail = cheapest(states)
    return cost, trail.letters()


def test_every_short_conversation_against_all_ways():
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    faults = {0: "", 1: "blank", 3: "truncated"}
    for n in range(4):
        for rows in product(product("suat", faults), repeat=n):
            assert states_of(rows) == best_audit([(names[i], "x", faults[f]) for i, f in rows])[:2]


@pytest.mark.parametrize("weak", [False, True])
def test_trails_compare_as_their_letters_even_when_hashes_meet(monkeypatch, weak):
    if weak:
        monkeypatch.setattr(module, "_rolled", lambda value, piece: (value + len(piece)) % 3)
    random.seed(weak)
    trails = [ROOT]
    for _ in range(400):
        trails.append(Trail(random.choice(trails[-40:] + [ROOT]), "".join(random.choice("DK") for _ in range(random.randint(0, 5)))))
    for _ in range(4000):
        x, y = random.choice(trails), random.choice(trails)
        assert less(x, y) == (x.letters() < y.letters())
