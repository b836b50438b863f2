import random
from zlib import crc32

import numpy as np
import pytest

from roamframe.llm.toxicity import chain_marginals, fit, judged, toxicity, without_toxic

NAMES = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(31)
    plain = ["".join(rng.choice("aeiourtnsl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["zwonk", "krelba", "vurtig", "plaxo"]
    ends = ["", "s", "en", "isch", "ero"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(ends))
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def chain(spark, documents, corpus):
    return fit(documents(corpus[0]), spark.createDataFrame(corpus[1], NAMES))


def test_held_out_accuracy(documents, corpus, chain):
    rows, labels = corpus
    got = {r.doc_id: r for r in toxicity(documents(rows), chain).collect()}
    own = [i for i in got if crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} == set(own) and len(own) > 100
    right = sum(got[i].predicted == labels[i][2] for i in own)
    assert right >= 0.95 * len(own)


def test_offsets_are_of_toxic_words(corpus, chain):
    text = "Quiet words zwonken and é😀 KRELBAS here."
    _, row, start, end = judged([text], chain)
    assert [text[a:b] for a, b in zip(start, end)] == ["zwonken", "KRELBAS"]


def test_labels_of_held_out_rows_are_not_used(spark, documents, corpus, chain):
    rows, labels = corpus
    turned = [(i, q, 1 - t if crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = fit(documents(rows), spark.createDataFrame(turned, NAMES))
    assert np.array_equal(chain.weights, again.weights) and np.array_equal(chain.curve, again.curve)


def test_odd_rows(documents, odd, chain):
    got = toxicity(documents([*odd, (20, "zwonk zwonk zwonk plaxo")]), chain).collect()
    assert len(got) == len(odd) + 1 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    left = without_toxic(documents([*odd, (20, "zwonk zwonk zwonk plaxo")]), chain)
    assert left.columns == documents([]).columns and left.count() == len(odd)
    assert toxicity(documents([]), chain).count() == 0


def test_without_labels(spark, documents):
    none = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 0)], NAMES)
    got = toxicity(documents([(1, "a b"), (2, None)]), fit(documents([(1, "a b"), (2, None)]), none)).collect()
    assert [round(r.score, 6) for r in got] == [0.05, 0.05]


def test_marginals_match_all_paths():
    rng = np.random.default_rng(1)
    move = rng.uniform(0.2, 3, (2, 2))
    sizes = np.array([3, 0, 1, 9, 7])
    odds = rng.uniform(0.1, 5, sizes.sum())
    got, at = chain_marginals(odds, sizes, move), 0
    for n in sizes:
        weight, ones = 0.0, np.zeros(n)
        for path in range(2**n if n else 0):
            state = [(path >> k) & 1 for k in range(n)]
            w = 1.0
            for k, s in enumerate(state):
                # The first word is entered from state 0 and state 1 alike.
                w *= (odds[at + k] if s else 1.0) * (move[0, s] + move[1, s] if k == 0 else move[state[k - 1], s])
            weight += w
            ones += w * np.array(state)
        assert np.allclose(got[at : at + n], ones / weight if n else [])
        at += n


def test_marginals_of_long_chains_do_not_overflow():
    odds = np.concatenate([np.full(5000, 1e-12), np.full(5000, 1e12)])
    p = chain_marginals(odds, np.array([10_000]), np.array([[1.0, 0.1], [0.2, 1.0]]))
    assert np.isfinite(p).all() and p[:4990].max() < 1e-6 and p[5010:].min() > 1 - 1e-6
