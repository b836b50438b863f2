import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from roamframe.llm.warc import look_up, parsed, record, url_key, warc_round_trip, write_archives, write_index
from roamframe.storage import new_path

PAGES = "page_id bigint, url string, html string, key string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "d") for i, u, h in rows], PAGES)


def sample():
    random.seed(11)
    shared = ["<p>" + "long enough " * 20, "é" * 60, "short"]
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 13}", random.choice([*shared, f"own page {i} " * 12])) for i in range(200)]
    return [*rows, (900, None, None), (901, "no url at all", ""), (902, "HTTP://user@WWW.Example.org:8080?q=1#f", "z" * 99), (None, "http://a.b/", shared[0]), (903, "http://a b/\n", "x" * 200_000)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h)
        to = to if len(data) >= 100 and to != i else None
        out.append((i, len(data), sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def test_round_trip(spark, rows_of):
    rows = sample()
    got = warc_round_trip(pages(spark, rows))
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(rows)


def test_lookup_finds_every_capture_of_a_key(spark):
    rows = [(i, f"http://x.org/{i % 5}", f"{i}") for i in range(60)]
    root = new_path(spark, "warc")
    index = write_index(write_archives(pages(spark, rows), root), root, block_lines=4)
    keys = spark.createDataFrame([("org,x)/3",), ("org,x)/nothing",), ("a",), ("zz",)], "key string")
    assert sorted(r.page_id for r in look_up(keys, index).collect()) == [i for i in range(60) if i % 5 == 3]


def test_empty_table(spark):
    assert warc_round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.a.org/x?y=1#top", "org,a,www)/x?y=1"),
        ("https://u:p@A.Org:443", "org,a)/"),
        ("ftp://a.org:2121/f", "org,a:2121)/f"),
        ("Plain Text", "plain%20text"),
        (None, "-"),
    ],
)
def test_url_key(spark, url, key):
    assert spark.range(1).select(url_key(F.lit(url).cast("string")).alias("k")).first().k == key


def test_damage_is_an_error():
    data = record(1, "http://a/", b"payload", sha256(b"payload").hexdigest(), None)
    assert parsed(data) == (1, 7, sha256(b"payload").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        parsed(data.replace(b"payload\r\n", b"pAyload\r\n"))
