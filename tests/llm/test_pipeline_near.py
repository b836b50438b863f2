import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from roamframe.llm.parity_join import parity_join  # noqa: E402


def changed(words, places):
    return " ".join("changed" + w if i in places else w for i, w in enumerate(words))


def test_near_copies_are_told_by_five_words_and_four_fifths(spark, documents):
    one, other = ([f"{c}{i}" for i in range(200)] for c in "ab")
    # 196 shingles of five words: 176 of 216 are shared after four changes, 171 of 221 after five.
    near, far = changed(one, (20, 60, 100, 140)), changed(other, (20, 60, 100, 140, 180))
    docs = documents([(1, " ".join(one)), (2, near), (3, " ".join(other)), (4, far)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4]
    # Four words: 181 of 213, under op3's 85 of 100.
    assert all(r.component_id == r.doc_id for r in parity_join(docs).collect())
