import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from roamframe import ordered as O


def test_blocked_windows_equal_plain_windows(spark):
    """One key holds most rows and spans many blocks; blocks may be empty."""
    rng = random.Random(3)
    rows = []
    for key, steps in (("hot", 700), ("a", 20), ("b", 1)):
        for step in sorted(rng.sample(range(2000), steps)):
            rows.append((key, step, rng.choice([None, 1, 2, 3]), rng.randint(0, 5)))
    df = spark.createDataFrame(rows, "k string, t int, v int, n int")
    got = O.with_ordered(
        df,
        ["k"],
        ["t"],
        O.step_block("t", 16),
        {
            "rn": O.row_number(),
            "s": O.running_sum("n"),
            "tot": O.total("n"),
            "ff": O.last_value("v"),
            "fi": O.first_value("v"),
            "pr": O.previous("v"),
            "fo": O.following("v"),
            "nx": O.next_value("v"),
        },
    )
    w = Window.partitionBy("k").orderBy("t")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k",
        "t",
        "v",
        "n",
        F.row_number().over(w).alias("rn"),
        F.sum("n").over(up).alias("s"),
        F.sum("n").over(Window.partitionBy("k")).alias("tot"),
        F.last("v", True).over(up).alias("ff"),
        F.first("v", True).over(up).alias("fi"),
        F.lag("v").over(w).alias("pr"),
        F.lead("v").over(w).alias("fo"),
        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("nx"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
