import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from roamframe.llm import toxicity
from roamframe.llm.pieces import pieces
from roamframe.llm.queries import ORACLE, QUERIES

public = pytest.importorskip("public_tokenizers")


def sample():
    rng = random.Random(41)
    words = ["".join(rng.choice("aeiourtnsl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(16)) for i in range(6)] + [(90, None)]
    rows, labels = [], []
    for i in range(420):
        own, toxic = text(rng.randint(1, 120)), i % 5 == 0
        if toxic:
            own = f"{own} zwonken {text(2)} krelba {text(1)} zwonk"
        if i % 17 == 3:
            own = f"{own} {rng.choice(items[:6])[1].upper()}."
        rows.append((i, own))
        labels.append((i, 1, int(toxic)))
    for i in range(60):
        own = rows[rng.randrange(420)][1]
        if i % 2:
            parts = own.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            own = " ".join(parts)
        rows.append((1000 - i, own.replace(" ", rng.choice([" ", "  ", "\n"]))))
    rows += [(2000, None), (2001, ""), (2002, "  "), (2003, "alone"), (None, "no id"), (5, rows[7][1]), (5, rows[7][1])]
    return rows, labels, items


def plain(rows, items, chain, model):
    """The five stages one after the other, by sets and all pairs."""
    scores, *_ = toxicity.judged([t or "" for _, t in rows], chain)
    rows = [r for r, s in zip(rows, scores) if s < toxicity.THRESHOLD]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(t), (i, t))
    rows = list(first.values())

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    for a in known:
        for b in known:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) or (a < b and rows[a][0] == rows[b][0]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    least = {}
    for k in known:
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    rows = [r for k, r in enumerate(rows) if r[0] is None or r[0] == least[find(k)]]
    letters = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    rows = [r for r in rows if not any(i is not None and t and letters(t) in letters(r[1]) for i, t in items)]
    ids, borders, _ = model.encode([t or "" for _, t in rows])
    return sorted((-1 if i is None else i, ids[a:b].tolist()) for (i, _), a, b in zip(rows, borders, borders[1:]))


def test_run_matches_a_plain_version(spark, documents, tmp_path):
    rows, labels, items = sample()
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    chain = toxicity.fit(documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    want = plain(rows, items, chain, pieces(public.path("piece_bpe_32k.model")))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.token_ids) for r in got) == want
    assert all(r.restored and r.n_tokens == len(r.token_ids) for r in got) and 200 < len(got) < 400


def test_stages_keep_the_columns_and_take_no_rows(spark, documents, tmp_path):
    for name, schema in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = documents([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "pieces":
            assert out.columns == docs.columns


def test_every_operator_is_registered():
    known = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(known) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
