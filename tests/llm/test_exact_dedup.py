import hashlib
import random
import re

from roamframe.llm.exact_dedup import exact_dedup
from roamframe.llm.ordering import in_order


def expected(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm):
        keep = min(groups[n], key=lambda k: (k is None, k))
        out.append((i, keep, len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def test_small_blocks_and_odd_rows(documents, rows_of, odd):
    random.seed(5)
    texts = ["".join(random.choice("ab ") for _ in range(random.randint(0, 60))) for _ in range(60)]
    short = [r for r in odd if len(r[1] or "") < 100]
    rows = [*short, *[(100 + i, random.choice(texts) + random.choice(["", " ", "\t"])) for i in range(300)]]
    got = exact_dedup(documents(rows), block_bytes=16)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == expected(rows)


def test_one_row_of_a_group_stays(documents, rows_of, odd):
    got = exact_dedup(documents([*odd, (1, "same  text"), (2, "same text")])).filter("kept")
    # Null, empty and blank differ: the first two are one text.
    assert rows_of(got, "doc_id") == [(1,), (3,), (5,), (6,), (7,), (8,), (9,)]


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0


def test_order_has_no_gaps_and_equal_keys_share_a_name(spark):
    random.seed(3)
    keys = [random.choice([5, 5, 5, 9, -2, 1 << 40]) for _ in range(500)]
    got = in_order(spark.createDataFrame([(k, i, k) for i, k in enumerate(keys)], "key bigint, i bigint, also bigint"), ["key"], ["i"]).collect()
    assert sorted(r.place for r in got) == list(range(500))
    names = {k: n for n, k in enumerate(sorted(set(keys)))}
    assert all(r.name == names[r.also] for r in got)
