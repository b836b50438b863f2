import random

from roamframe.llm.personal_data import Detector, fit, personal_data


def account(rng, valid=True):
    own = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int(own + "131400") % 97
    text = f"DE{check if valid else (check + 1) % 97:02}{own}"
    return " ".join(text[i : i + 4] for i in range(0, 22, 4))


def found(docs, detector):
    return {r.doc_id for r in personal_data(docs, detector).collect() if "account:" in r.spans}


def test_a_kind_with_few_candidates_goes_by_its_format(documents):
    rng = random.Random(5)
    rows = [(1, f"pay to {account(rng)} today"), (2, f"pay to {account(rng, False)} today"), (3, "page 5")]
    docs = documents(rows)
    detector = fit(docs)
    assert "account" not in detector.kinds
    assert found(docs, detector) == found(docs, Detector({})) == {1}


def test_a_rare_kind_of_a_large_table_is_fitted(documents):
    rng = random.Random(6)
    rows = [(i, f"page {i} of {rng.randrange(90)}") for i in range(30_000)]
    for i in range(80):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        rows[rng.randrange(300) + 300 * i] = (100_000 + i, f'key = "{token}" here' if i % 2 else f"see a_rather_long_name_of_a_thing_{i} here")
    docs = documents(rows)
    detector = fit(docs)
    assert "secret" in detector.kinds
    got = {r.doc_id for r in personal_data(docs, detector).collect() if "secret:" in r.spans}
    assert got == {100_000 + i for i in range(1, 80, 2)}


def test_every_valid_one_of_a_rare_kind_is_found_among_few_labels(documents):
    rng = random.Random(7)
    rows = [(i, f"page {i} of {rng.randrange(90)}") for i in range(30_000)]
    rows += [(100_000 + i, f"pay to {account(rng)} today") for i in range(40)]
    docs = documents(rows)
    assert found(docs, fit(docs)) == set(range(100_000, 100_040))


def test_a_number_inside_a_secret_leaves_it_whole():
    text = "key = a1b2c3d4_4111111111111111-1234567890 here"
    assert Detector({}).selected([text])[0] == [(6, 42, "secret")]
