import random

import numpy as np
import pytest

from roamframe.llm.pieces import decode_documents, encode_documents, piece_round_trip, pieces

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces(PATH)


def best(model, text):
    """Scores of the best segmentation by a plain search over all places and pieces."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PATH)
    known = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    longest = max(map(len, known))
    text = library.normalize(text) if text else ""
    scores, used = [0.0], [[]]
    for end in range(1, len(text) + 1):
        found = (-np.inf, None)
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            if piece in known:
                score = known[piece]
            elif len(piece) == 1:
                score = model.unknown_score
            else:
                continue
            if scores[start] + score > found[0]:
                found = (scores[start] + score, [*used[start], piece])
        scores.append(found[0])
        used.append(found[1])
    return scores[-1], used[-1]


TEXTS = ["", "a", " ", "Hello world", "  two  blanks   here ", "line\nbreak\ttab", "日本語のテキスト😀", "ру́сский язык", "ÀÿĀ 한국어", "\x00\x01", "x" * 70, "é ǅ ﬁ"]


def test_best_segmentation(model):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("thenandio  .,é\n") for _ in range(rng.randint(1, 60))) for _ in range(120)]
    ids, borders, score = model.encode(texts)
    for i, text in enumerate(texts):
        total, used = best(model, text)
        assert score[i] == pytest.approx(total)
        # A letter without a piece is spelled by its bytes.
        spelled = sum(1 if len(p) > 1 or model.single[ord(p)] >= 0 else len(p.encode()) for p in used)
        assert borders[i + 1] - borders[i] == spelled


def test_round_trip_of_everything(model):
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(200)) for _ in range(30)]
    texts = [t.replace("▁", "") for t in texts]
    ids, borders, _ = model.encode(texts)
    assert model.decode(ids, borders) == texts


def test_documents(spark, documents, odd):
    docs = documents(odd)
    coded = encode_documents(docs, PATH)
    assert [c for c in coded.columns if c not in ("n_tokens", "token_ids", "restored")] == [c for c in docs.columns if c != "text"]
    again = decode_documents(coded, PATH)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.text) for r in again.collect()), key=key) == sorted(((i, t or "") for i, t in odd), key=key)
    checked = piece_round_trip(docs, PATH).collect()
    assert len(checked) == len(odd) and all(r.restored for r in checked)
    assert {r.doc_id: r.n_tokens for r in checked}[4] == 0
    assert encode_documents(documents([]), PATH).count() == 0
