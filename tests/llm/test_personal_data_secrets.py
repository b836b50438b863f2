import random
import re

from roamframe.llm.personal_data import MORE, Detector, candidates

LETTERS = "ABCDEFabcdef0123456789_-xyz"


def secrets(text):
    return [s for s in candidates(text) if s[2] == "secret"]


def test_long_keys_are_found_whole():
    rng = random.Random(8)
    for n in (16, 128, 129, 300, 5000):
        key = "k1234x" + "".join(rng.choice(LETTERS) for _ in range(n - 6))
        text = f"before {key}. after"
        assert secrets(text) == [(7, 7 + n, "secret")]
        assert Detector({}).selected([text])[0][-1] == (7, 7 + n, "secret")
    # One digit far from both ends, and a tail that a hyphen must not set free.
    assert secrets("x " + "a" * 400 + "7" + "b" * 400 + " y") == [(2, 803, "secret")]
    assert secrets("x " + "a" * 150 + "-" + "b7" * 20 + " y") == [(2, 193, "secret")]


def test_stretches_lose_no_secret():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("a-_1") * rng.randint(1, 90) + rng.choice(["", "", " ", "."]) for _ in range(12))
        whole = [(m.start(), m.end()) for m in re.finditer(MORE["secret"], text) if re.search("[0-9]", m.group())]
        got = [(a, b) for a, b, _ in secrets(text)]
        assert set(whole) <= set(got) and len(got) == len(set(got)), text
        assert all(not re.search("[A-Za-z0-9_-]", text[max(0, a - 1) : a] + text[b : b + 1]) for a, b in got), text


def test_a_run_of_a_million_is_one_candidate():
    text = "ab1-" * 250_000
    assert secrets(text) == [(0, len(text), "secret")]
