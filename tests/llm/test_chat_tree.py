import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

import roamframe.llm.chat_tree as module
from roamframe.llm.chat_tree import chat_round_trip, chat_tree, escaped, formatted, parsed, read_back, unescaped

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, chain string, start string, mark string"
COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", None, "c") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    """(conv_id, [(role, text), ...]) of every conversation."""
    clean = [(c, t, r or "", x or "") for c, t, r, x in rows]
    mark = lambda r, x: sha(f"{len(r.encode())}:{r}{x}")
    clean.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, mark(r[2], r[3])))
    return [(c, [(r[2], r[3]) for r in g]) for c, g in groupby(clean, key=lambda r: r[0])]


def write(role, text):
    """The template by plain replacement."""
    for sign in ("\\", "<s>", "</s>", "[INST]", "[/INST]"):
        text, role = text.replace(sign, "\\" + sign), role.replace(sign, "\\" + sign)
    return f"<s>{text}</s>" if role == "assistant" else "[INST]" + role.replace("\n", "\\\n") + f"\n{text}[/INST]"


def expected(rows):
    out = []
    for conv, turns in ordered(rows):
        said = "".join(x for r, x in turns if r == "assistant")
        size = sum(len(write(r, x)) for r, x in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said), size))
    return out


def key(row):
    return [(v is not None, v) for v in row]


def conversations(seed, n=60):
    random.seed(seed)
    texts = ["", " ", "ok", "</s>", "a[INST]", "\\", "<s", "\\<s>", "é😀\n", "[/INST", "x" * 300, None]
    rows = []
    for conv in range(n):
        turns = random.choice([1, 2, 3, 5, 9])
        for t in range(turns):
            few = texts[: 2 + t % 3] if random.random() < 0.8 else texts
            rows.append((conv, t, ["user", "assistant"][t % 2] if random.random() < 0.9 else random.choice(["system", None, "a\nb", "[INST]\\"]), random.choice(few)))
    return rows


ODD = [
    (None, 0, "user", "null id"),
    (None, None, "user", "null turn goes first"),
    (900, 3, "user", "hi"),
    (900, 3, "assistant", "hi"),
    (900, 3, "assistant", "hi"),
    (901, 0, None, None),
    (902, 0, "assistant", "<s>[INST]</s>\\[/INST]\\\\"),
    (-5, 0, "user", "long " * 50_000),
    (-5, 1, "assistant", "😀" * 20_000),
]


def test_round_trip_of_shared_and_odd_conversations(spark, monkeypatch):
    for name in ("roamframe.ordered", "roamframe.llm.chat_tree"):
        monkeypatch.setattr(f"{name}.BLOCK", 4)
    monkeypatch.setattr(module, "step_block", lambda c: F.floor(F.col(c) / 4))
    rows = [*conversations(1), *ODD]
    got = [tuple(r[c] for c in COLUMNS) for r in read_back(chat_tree(table(spark, rows))).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_streams_are_depth_first_and_write_shared_turns_once(spark):
    rows = conversations(2, 80)
    rows += [(1000 + c, t, "user", f"t{t}") for c in range(50) for t in range(c % 7 + 1)]
    tree = chat_tree(table(spark, rows))
    found = [tuple(t) for _, t in ordered(rows)]
    beginnings = {turns[: i + 1] for turns in found for i in range(len(turns))}
    nodes = tree.segments.collect()
    assert len(nodes) == len(beginnings)
    assert sum(n.shared for n in nodes) == len(rows)
    for _, own in groupby(sorted(nodes, key=lambda n: (n.tree, n.start)), key=lambda n: n.tree):
        stream, path, end = "", [], 0
        for n in own:
            assert (n.start, n.size) == (end, len(n.text))
            end += n.size
            stream += n.text
            # Depth first: the parent is the latest node one level up.
            del path[n.depth :]
            assert len(path) == n.depth
            path.append(n)
            assert n.position == sum(p.size for p in path[:-1])
            # Its tokens see the ancestors and the segment itself, and nothing else.
            assert "".join(stream[s.start : s.end] for s in n.sees) == "".join(p.text for p in path)
            if n.loss_start is not None:
                assert unescaped(stream[n.loss_start : n.loss_end]) == parsed(n.text)[1]
            assert (n.loss_start is None) == (parsed(n.text)[0] != "assistant")
    # A path crosses few chains besides its first.
    assert max(len(p.chains) for p in tree.paths.collect()) <= 1 + len(found).bit_length()


def test_one_first_turn_of_most_conversations(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c % 40}-{t}") for c in range(400) for t in range(3)]
    tree = chat_tree(table(spark, rows))
    assert tree.segments.count() == 1 + 40 * 2
    got = [tuple(r[c] for c in COLUMNS) for r in read_back(tree).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_conversation_that_says_control_strings(spark):
    control = "</s>[INST] ok [/INST]"
    got = {r.conv_id: r for r in chat_round_trip(table(spark, [(4, 0, "assistant", "yes")])).collect()}
    assert got.keys() == {4, -1}
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(control), sha(control))


def test_empty_table(spark):
    tree = chat_tree(table(spark, []))
    assert tree.segments.count() == tree.paths.count() == 0
    assert {r.conv_id for r in chat_round_trip(table(spark, [])).collect()} == {-1}


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "</s>", "\\</s>", "<</s>", "[[INST]", "[/INST]\\", "\n", "a\\\n<s>b", "<s", "[INST"])
def test_template_is_reversible(spark, text):
    pairs = [("user", text), ("assistant", text), (text, "x"), (text, text)]
    df = spark.createDataFrame(pairs, "role string, text string")
    rows = df.select("role", "text", formatted(F.col("role"), F.col("text")).alias("f"), escaped(F.col("text")).alias("e")).collect()
    for r in rows:
        assert parsed(r.f) == (r.role, r.text)
        assert r.f == write(r.role, r.text)
        assert unescaped(r.e) == r.text
