import random

from pyspark.sql import functions as F

from roamframe.functions import options as O
from roamframe.functions import text as T


# answer, pool, seeds, options in order; worked out by hand.  The order is turned by the sum of the
# answer's code points modulo 4, noted behind each case.
CASES = [
    ("zz", ["p", "q", "zz", "r", "s"], [], ["p", "q", "zz", "r"]),  # 244: 0
    ("a", ["b", "c", "d"], [], ["b", "c", "d", "a"]),  # 97: 1
    ("b", ["", "c", "c", "d", "e"], [], ["d", "e", "b", "c"]),  # 98: 2
    ("c", ["d", "c", "e", "f"], [], ["f", "d", "c", "e"]),  # 99: 3
    ("d", ["w", "x", "y", "z", "d"], [], ["d", "x", "y", "z"]),  # 100: 0
    ("é", ["k", "l", "m"], [], ["k", "l", "m", "é"]),  # 233: 1
]


def _options(spark, cases):
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i int, answer string, pool array<string>, seeds array<string>"
    )
    choice = O.options_rotate(F.col("answer"), F.col("pool"), F.col("seeds"))
    return sorted(df.withColumn("c", choice).collect(), key=lambda r: r.i)


def test_options_of_known_cases(spark):
    for r, (*_, want) in zip(_options(spark, [c[:3] for c in CASES]), CASES):
        assert r.c.ordered == want, r
        assert want["ABCD".index(r.c.key)] == r.answer


def test_seeds_fill_up_with_directions(spark):
    got = _options(spark, [("to your left", [], ["opposite_direction"]), ("to your left", ["behind you"], ["to your left"])])
    assert O.OPPOSITE["to your left"] in got[0].c.ordered
    assert all(len(set(r.c.ordered)) == 4 and r.answer in r.c.ordered for r in got)


def test_options_are_four_and_distinct(spark):
    rng = random.Random(2)
    words = O.FILLERS + ["above you", "a → b ×2 90° …", "x", "", "naïve 🙂"]
    seeds = ["opposite_direction", "orthogonal_direction", "behind you", "pre_move_bearing"]
    cases = [
        (rng.choice([w for w in words if w]), rng.choices(words, k=rng.randint(0, 6)), rng.sample(seeds, rng.randint(0, 4)))
        for _ in range(200)
    ]
    for r in _options(spark, cases):
        ordered = r.c.ordered
        assert len(ordered) == len(set(ordered)) == 4 and all(ordered)
        assert ordered["ABCD".index(r.c.key)] == r.answer
        # Turned back, the pool's words keep their order.
        turn = sum(map(ord, r.answer)) % 4
        back = ordered[4 - turn :] + ordered[: 4 - turn]
        own = [w for w in dict.fromkeys(r.pool) if w and w in back and w != r.answer]
        assert [w for w in back if w in own] == own


def test_names_and_phrases(spark):
    df = spark.createDataFrame(
        [("Undefined", "ObjaScooter|4|5"), ("FloorLamp", "X|4"), (None, "Cup|1"), (" N/A ", "|odd")],
        "c string, i string",
    )
    got = [r.n for r in df.select(T.display_name(F.col("c"), F.col("i")).alias("n")).collect()]
    assert got == ["ObjaScooter", "FloorLamp", "Cup", "|odd"]
    df = spark.createDataFrame([(None,), ("null",), ("Shelf|2|1",), ("Sofa",)], "r string")
    got = [r.p for r in df.select(T.receptacle_phrase(F.col("r")).alias("p")).collect()]
    assert got == ["on the floor", "on the floor", "on/in the Shelf", "on/in the Sofa"]


def test_scrub_hides_exact_and_lower_case(spark):
    df = spark.createDataFrame(
        [("Go To Your Left or to your left.", "To your left"), ("Nothing here", "behind you"), ("x", None)],
        "t string, a string",
    )
    got = [r.s for r in df.select(T.scrub_leak(F.col("t"), F.col("a")).alias("s")).collect()]
    assert got == ["Go To Your Left or […].", "Nothing here", "x"]


def test_camel_tail(spark):
    df = spark.createDataFrame([("FloorLamp",), ("cup",), ("ObjaBigScooter",)], "w string")
    got = [r.t for r in df.select(T.camel_tail(F.col("w")).alias("t")).collect()]
    assert got == ["lamp", "cup", "big"]
