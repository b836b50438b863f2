import random

import pytest

from roamframe.llm.token_counts import encoder, token_counts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    return [len(own.encode(t or "", add_special_tokens=False)) for t in texts]


def test_counts_like_the_library(documents, odd):
    rng = random.Random(8)
    letters = "ab  '\n\t.,!09é٣½ßΩ一😀   \x1c\x85ǅ्"
    texts = ["I'll they're 's <|endoftext|> x<|endoftext|>", "<|endoftext", "   ", "a" * 30_000, "1 2  3   4\n\n5"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = [*odd, *[(100 + i, t) for i, t in enumerate(texts)]]
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts(documents(rows), PATH).collect()}
    for (i, t), n in zip(rows, library([t for _, t in rows])):
        assert got[i, len((t or "").encode())] == (n, n > 512)


def test_frequent_table_changes_nothing():
    own = encoder(PATH)
    text = "The cat sat on the mat, and the other cat didn't."
    assert own.count(text, {}) == own.count(text, {" the": 1, " cat": own.length(" cat")}) == library([text])[0]


def test_high_characters_are_looked_up():
    own = encoder(PATH)
    text = "plain words 漢字 and 한글, a smile 😀 x　y"
    assert [plain for _, plain in own.stretches(text)] == [True]
    assert own.count(text, {}) == library([text])[0]


def test_only_the_strange_stretch_goes_to_the_library():
    rng = random.Random(11)
    own = encoder(PATH)
    parts = list(own.stretches("one two x<|endoftext|>y three. four"))
    assert parts == [("one two", True), (" x<|endoftext|>y", False), (" three. four", True)]
    # Characters of newer Unicode versions, unassigned ones and private ones among plain text.
    high = [chr(c) for c in (0x3000, 0x4E00, 0x9FFF, 0xFEFF, 0xE000, 0x10D40, 0x11F50, 0x1E4D0, 0x1FAE9, 0x2EBF0, 0x31350, 0x323B0, 0xE0100, 0x10FFFF)]
    letters = [*high, *"ab1!. \n'", " ", " ", "<|endoftext|>", "s'll"]
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert "".join(p for p, _ in own.stretches(text)) == text
        assert own.count(text, {}) == library_of(own, text)


def test_odd_characters_in_any_place():
    """Characters declared odd go to the library, in whatever stretch, and the sum stays the same."""
    rng = random.Random(12)
    own = encoder(PATH)
    own.tried[ord("ꙮ")], before = 2, own.tried[ord("ꙮ")]
    try:
        for _ in range(1000):
            text = "".join(rng.choice("ab1!.'  \n\tꙮé") for _ in range(rng.randint(1, 50)))
            assert own.count(text, {}) == library_of(own, text)
    finally:
        own.tried[ord("ꙮ")] = before


def library_of(own, text):
    return len(own.tokenizer.encode(text, add_special_tokens=False))


def test_empty_table(documents):
    assert token_counts(documents([]), PATH).count() == 0
