"""The trees against personal data and look-alikes planted into texts that they were not fitted to."""

import random

import pytest

from roamframe.llm.personal_data import MORE, Detector, fit, personal_data
from roamframe.llm.planted import ALIKE, PERSONAL, planted

WORDS = "the house on a hill was sold to them in spring and nobody knew why it had been empty for so many years".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def detector(documents):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(5, 200))) for i in range(400)]
    return fit(documents([*rows, (1000, None), (1001, ""), (1002, rows[0][1])]))


def test_every_kind_is_learnt_and_measured(detector):
    assert set(PERSONAL) == set(ALIKE) == set(MORE) == set(detector.kinds) == set(detector.measured)
    for kind, (recall, precision, n) in detector.measured.items():
        assert n >= 100 and recall >= 0.9 and precision >= 0.9, (kind, recall, precision)


def test_planted_spans_are_selected_and_look_alikes_are_not(documents, detector):
    rng = random.Random(2)
    rows, told = [], {}
    for kind in PERSONAL:
        for personal in (True, False):
            for _ in range(150):
                around, start, end = planted(prose(rng, 40), f"other {len(rows)}", kind, personal)
                told[len(rows)] = kind, personal, start, end
                rows.append((len(rows), around))
    hits = {(kind, personal): 0 for kind in PERSONAL for personal in (True, False)}
    for r in personal_data(documents(rows), detector).collect():
        kind, personal, start, end = told[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        # Personal data count as found under any name; a look-alike is taken for its kind only by that name.
        own = [(int(a), int(b)) for k, a, b in spans if personal or k == kind]
        hits[kind, personal] += any(2 * (min(end, b) - max(start, a)) > end - start for a, b in own)
    for kind in PERSONAL:
        assert hits[kind, True] >= 135, (kind, hits)
        assert hits[kind, False] <= 15, (kind, hits)


def test_prose_is_left_alone(documents, detector):
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 60)} version 12.4 of page 12, a_rather_long_name_of_a_thing_{i} {'-' * 40} 12.05.2021") for i in range(200)]
    assert {r.spans for r in personal_data(documents(rows), detector).collect()} == {""}


def test_a_secret_without_a_digit_is_found(detector):
    text = "set token = QxZrTnWvKpLmHsBdJfGcYtRe now"
    assert detector.selected([text])[0] == [(12, 36, "secret")]


def test_fitting_does_not_depend_on_rows_order_or_copies(documents):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30)) for i in range(60)]
    one = fit(documents(rows).repartition(3))
    two = fit(documents([*reversed(rows), *rows * 3]).repartition(5))
    assert one.measured == two.measured
    assert {k: p for k, (_, p) in one.kinds.items()} == {k: p for k, (_, p) in two.kinds.items()}


def test_planting_stands_between_words():
    rng = random.Random(5)
    for kind in PERSONAL:
        for i in range(50):
            text = prose(rng, rng.randint(0, 30))
            around, start, end = planted(text, i, kind, True)
            assert planted(text, i, kind, True) == (around, start, end)
            assert not around[:start][-1:].isalnum() and not around[end : end + 1].isalnum()


def test_empty_texts_are_planted_into(documents):
    assert fit(documents([(i, "" if i % 2 else None) for i in range(50)])).kinds.keys() <= set(MORE)
    assert Detector({}).measured == {}
