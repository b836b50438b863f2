import random

import numpy as np

from roamframe.llm import decontaminate
from roamframe.llm.decontaminate import contaminated, indexed, matches, without_matches


def plain(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text or "").split())


def least_edits(patterns, text):
    """Of each pattern against any part of the text; no filter and no band."""
    p = np.array([[ord(c) for c in x] for x in patterns])
    t = np.array([ord(c) for c in text])
    row = np.zeros((len(p), len(t) + 1), dtype=int)
    ramp = np.arange(len(t) + 1)
    for i in range(p.shape[1]):
        new = np.full_like(row, i + 1)
        new[:, 1:] = np.minimum(row[:, :-1] + (p[:, i : i + 1] != t), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return int(row.min())


def holds(text, item):
    t, p = plain(text), plain(item)
    if not t or not p:
        return False
    if len(p) < 10:
        return t == p
    if len(p) < 20:
        return f" {p} " in f" {t} "
    m = min(len(p), 50)
    return least_edits([p[s : s + m] for s in range(len(p) - m + 1)], t) <= 3 * m // 50


def expected(docs, items):
    return sorted({(d, i) for d, text in docs for i, item in items if i is not None and holds(text, item)})


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(max(1, len(chars)))
        chars[at : at + 1] = rng.choice([[], ["q"], [*chars[at : at + 1], "z"]])
    return "".join(chars)


def test_matches_full_alignment(spark, documents, odd):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n).capitalize() + ".") for i, n in enumerate((5, 7, 8, 9, 12, 30))] + [(50, None), (51, ""), (None, text(20)), (52, "tiny"), (53, "two tiny words")]
    docs = []
    for i, item in items:
        for edits in (0, 1, 2, 3, 4, 6):
            docs.append((len(docs), f"{text(6)}, {edited(rng, item or "none", edits).upper()}!  {text(5)}"))
        docs.append((len(docs), (item or "")[: len(item or "") // 2] + " " + text(8)))
    small = [r for r in odd if r[0] is None or r[0] < 8]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in contaminated(documents([*docs, *odd[-2:]]), table).collect())
    assert got == expected(docs, items) and len(got) > 10
    left = without_matches(documents([*docs, *small]), table)
    assert left.columns == documents([]).columns
    bad = {d for d, _ in got}
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted([d for d, _ in docs if d not in bad] + [d for d, _ in small if d is not None])


def test_offsets_span_the_passage(spark, documents):
    item = "seven green lamps hang over the quiet harbour while nobody counts the passing boats"
    text = "Intro é😀:  " + item.upper() + " and more words."
    row = contaminated(documents([(1, text)]), spark.createDataFrame([(7, item)], "item_id bigint, text string")).first()
    assert (row.doc_id, row.item_id, row.least_edits) == (1, 7, 0)
    # A blank beside the passage is part of no window.
    assert text[row.start : row.end].strip().lower() == item


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a sentence that is long enough to be searched for")], "item_id bigint, text string")
    assert contaminated(documents([(1, "text")]), none).count() == 0
    assert without_matches(documents([(1, "text")]), none).count() == 1
    assert contaminated(documents([]), some).count() == 0 == without_matches(documents([]), some).count()


def test_a_fragment_is_found_at_every_offset(spark, documents):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("aeioutnrs") for _ in range(5)) for _ in range(30))
    cut = [(s, item[s : s + 50]) for s in range(len(item) - 49)]
    docs = [(s, f"Qq {part}, qq") for s, part in cut]
    near = [(1000 + s, f"Qq {part[:20]}x{part[20:]}") for s, part in cut]
    none = [(2000 + s, f"Qq {item[s : s + 40]} qq qq qq qq") for s in range(0, 130, 7)]
    table = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = sorted(r.doc_id for r in contaminated(documents(docs + near + none), table).collect())
    assert got == sorted({d for d, _ in expected(docs + near + none, [(1, item)])})
    assert set(got) >= {d for d, _ in docs + near}


def test_short_items_count_as_a_whole(spark, documents):
    items = [(1, "Blue harbour"), (2, "(Yes.)"), (3, "twenty letters in all"), (4, "yes")]
    docs = [(1, "by the BLUE  harbour, at night"), (2, "blue harbours"), (3, "a blue harbor"), (4, " yes! "),
            (5, "yes and no"), (6, "so twenty leters in all here"), (7, "twenty leters in al"), (8, "skyblue harbour"),
            (9, "blue harbour"), (10, "skyblue harbour, blue harbour"), (11, ""), (12, "!?")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = contaminated(documents(docs), table).collect()
    got = sorted((r.doc_id, r.item_id) for r in rows)
    assert got == expected(docs, items) == [(1, 1), (4, 2), (4, 4), (6, 3), (9, 1), (10, 1)]
    spans = {(r.doc_id, r.item_id): docs[r.doc_id - 1][1][r.start : r.end] for r in rows}
    assert spans[1, 1] == "BLUE  harbour" and spans[10, 1] == "blue harbour" and spans[4, 2] == "yes"


def test_a_phrase_of_very_many_items(monkeypatch):
    monkeypatch.setattr(decontaminate, "TOGETHER", 20_000)
    rng = random.Random(6)
    phrase = "choose the best answer"
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(8))
    items = [(i, f"{phrase} {word()} {word()} {word()} {word()}") for i in range(10_000)]
    texts = [f"{phrase} of them all. " * 4, f"Now {items[4321][1]}!", f"{phrase} {word()} " * 2, items[9999][1][5:]]
    row, item, edits, _, _ = matches(texts, indexed(items))
    assert sorted(set(zip(row.tolist(), item.tolist()))) == [(1, 4321), (3, 9999)] and edits.min() == 0


def test_many_windows_are_aligned_in_parts(monkeypatch):
    rng = random.Random(7)
    item = " ".join("".join(rng.choice("aeioutnrs") for _ in range(6)) for _ in range(60))
    whole = matches([item], indexed([(1, item)]))
    monkeypatch.setattr(decontaminate, "ALIGNED", 16)
    parts = matches([item], indexed([(1, item)]))
    assert [sorted(c.tolist()) for c in whole] == [sorted(c.tolist()) for c in parts]
    assert whole[3].min() == 0 and whole[4].max() == len(item)
