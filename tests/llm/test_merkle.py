import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from roamframe.llm.merkle import NONE, depth, fold, manifest_check, numbered_leaves, proof_digest, proofs, row_digest, steps_of, stored_levels

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, tree string, pos string, digest string, n string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        last = rows[-1]
        rows.append([H("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return rows


def expected(rows):
    """The manifest worked out level by level in one place."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for pos, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            seen = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                seen = leaf_of([*r[:3], r[3] + 1, r[4]])
            proof = ""
            for tower, at in ((trees[g], pos), (top, t)):
                for row in tower[:-1]:
                    other = row[at ^ 1] if at ^ 1 < len(row) else ""
                    seen = H(other + seen if at % 2 else seen + other)
                    proof += other
                    at //= 2
            root = top[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], root, H(proof), seen, seen == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def same(spark, rows, every):
    df = spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], SCHEMA)
    got = [tuple(r[c] for c in COLUMNS) for r in manifest_check(df, every).collect()]
    order = lambda r: [(v is not None, v) for v in r]
    assert sorted(got, key=order) == sorted(expected(rows), key=order)


@pytest.mark.parametrize("every", [1, 2, 3, 6])
def test_trees_of_many_sizes(spark, every):
    random.seed(every)
    rows = []
    for size, lang in enumerate([None, "", "de", "en", "fr", "é", "zz", "日本", "😀"]):
        for _ in range([1, 2, 3, 5, 8, 9, 17, 33, 70][size]):
            i = random.choice([None, random.randrange(10**6), random.randrange(30)])
            rows.append((i, random.choice([None, "", "web"]), lang, random.choice([None, 0, 12345, -3]), random.choice([None, "", "é😀" * 9, "a" * 50])))
    rows += rows[:9]
    same(spark, rows, every)


def test_one_row_and_no_row(spark):
    same(spark, [(7, "s", "en", 3, "text")], 6)
    assert manifest_check(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_every_few_levels_are_stored_and_proofs_hold(spark):
    n = 300
    rows = spark.range(n).selectExpr("id", "cast(null as string) as lang").withColumn("digest", row_digest([F.col("id")]))
    leaves = numbered_leaves(rows, "lang", "id")
    stored = stored_levels(leaves.select("tree", "n", "pos", "digest"), 3)
    assert [level.count() for level in stored] == [300, 38, 5, 1]
    got = proofs(leaves, 3, ["id"]).collect()
    assert len(got) == n
    for r in got:
        steps = steps_of(bytes(r.path))
        assert len(steps) == depth(n)
        assert fold(bytes(r.digest), steps) == bytes(r.root)
        assert proof_digest(steps) != proof_digest(steps[1:]) or steps[0][:1] == NONE


def test_length_prefixes_keep_rows_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("a1:b", ""), (None, "-"), ("-", None), ("", "ab")], "x string, y string")
    assert df.select(row_digest([df.x, df.y]).alias("d")).distinct().count() == 5
