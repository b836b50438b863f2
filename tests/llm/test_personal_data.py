import random
import re
from hashlib import sha256

import numpy as np
import pytest

from roamframe.llm.personal_data import BASE, Detector, base_spans, fit, luhn, personal_data, redacted
from roamframe.llm.trees import boosted, least_threshold


def by_patterns(text):
    """The base kinds by their patterns over the whole text, one match after the other."""
    spans = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(spans)]


CASES = [
    "mail a.b@c.de, x@y@z.org; @q.de a@b a@b.c.d- %@x.y a@b..c a@b.c@d.e",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.2.3.255 1.2.3 9.9.9.9999 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000 0000 0000 0 12",
    "+1 (042) 555-7845 +49 30 12 +4930 1234567890123456 +1.2.3.4 +12345678901 +",
    "é😀 a@b.de 4111111111111111+1 202 555 0100",
]


def test_base_kinds_match_the_patterns():
    rng = random.Random(12)
    texts = CASES + ["".join(rng.choice("ab@.1 9-+()%é") for _ in range(60)) for _ in range(3000)]
    for text in texts:
        assert base_spans(text) == by_patterns(text), text


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(400):
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        token = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        parts = ["plain words", f'token = "{token}"', f"card {digits}", f"call 030 {digits[:3]} {digits[3:8]}", "version 12.34-56", "some_long_identifier_name_here_4", "mail jo(at)site dot org"]
        rows.append((i, " and ".join(rng.sample(parts, 3))))
    return rows


@pytest.fixture(scope="module")
def detector(documents):
    return fit(documents(corpus()))


def test_added_spans_and_base_digest(documents, detector, odd):
    rows = [*odd, *[(1000 + i, t) for i, t in enumerate(CASES)], (2000, 'x token = "0123456789abcdef0123456789abcdee" y')]
    got = personal_data(documents(rows), detector).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = by_patterns(texts[r.doc_id] or "")
        told = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in base) for k in BASE]
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))
    assert [r.spans for r in got if r.doc_id == 2000] == ["secret:11:43"]


def test_redaction(documents, detector):
    rows = [(1, "to a@b.de or +1 202 555 0100."), (2, None), (3, "nothing")]
    got = {r.doc_id: r.text for r in redacted(documents(rows), detector).collect()}
    assert got == {1: "to [email] or [phone].", 2: None, 3: "nothing"}


def test_nothing_to_fit(documents):
    empty = fit(documents([]))
    assert empty.kinds == {}
    assert personal_data(documents([]), empty).count() == 0
    assert personal_data(documents([(1, "a@b.de")]), Detector({})).first().n_email == 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosted(x[:1000], y[:1000])
    p = model.probability(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.95
    least = least_threshold(p, y[1000:], 0.99)
    assert y[1000:][p >= least].mean() >= 0.99
    assert least_threshold(np.array([0.5, 0.5]), np.array([0.0, 0.0]), 0.9) > 1
