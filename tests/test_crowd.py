import math
import random

import pytest

from roamframe.operators.edges import edges_allocentric

SCHEMA = (
    "episode_id int, step int, object_id string, det_ord int, category string, "
    "local_x double, local_y double, local_z double"
)


def brute(points, k, radius):
    out = set()
    for _, _, a, _, _, *p in points:
        near = []
        for _, _, b, o, _, *q in points:
            d = math.sqrt(sum((v - u) ** 2 for u, v in zip(p, q)))
            if a != b and d <= radius:
                near.append((d, o, b))
        for rank, (_, _, b) in enumerate(sorted(near)[:k], 1):
            out.add((a, b, rank))
    return out


def crowd(seed):
    """A dense clump, many objects at one place, a line of far-apart points, an outlier."""
    rng = random.Random(seed)
    places = [tuple(round(rng.gauss(0, 0.05), 3) for _ in range(3)) for _ in range(60)]
    places += [(0.5, 0.5, 0.5)] * 25
    places += [(1.5 * i, 0.0, 0.0) for i in range(1, 8)]
    places += [tuple(round(rng.uniform(-2, 2), 3) for _ in range(3)) for _ in range(60)]
    places.append((50.0, 0.0, 0.0))
    rng.shuffle(places)
    return [(0, 0, f"O|{i}", i, "c", *map(float, p)) for i, p in enumerate(places)]


@pytest.mark.parametrize("array_objects", [10, 512])
def test_neighbours_match_brute_force(spark, array_objects):
    points = crowd(5)
    small = [(1, 3, f"S|{i}", i, "c", 0.3 * i, 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(points + small, SCHEMA)
    edges = edges_allocentric(df, array_objects=array_objects)
    rows = edges.select("episode_id", "source", "target", "ord_minor").collect()
    got = {(r.source, r.target, r.ord_minor) for r in rows if r.episode_id == 0}
    assert got == brute(points, 3, 1.5)
    got = {(r.source, r.target, r.ord_minor) for r in rows if r.episode_id == 1}
    assert got == brute(small, 3, 1.5)


def test_neighbours_across_cell_borders(spark):
    """Points exactly a radius apart on both sides of every border, far out, and without a place."""
    places = [(6.0 * i + d, 0.0, -6.0 * i) for i in range(-2, 3) for d in (-1.5, -0.75, 0.0, 0.75, 1.5)]
    places += [(x, y, z) for x in (-0.5, 0.5) for y in (5.9, 6.1) for z in (-6.4, -5.6)]
    places += [(1e7, 0.0, 0.0), (1e7 + 1.5, 0.0, 0.0), (math.nan, 0.0, 0.0), (math.inf, 0.0, 0.0), (0.0, -math.inf, 0.0)]
    points = [(0, 0, f"O|{i}", i, "c", *p) for i, p in enumerate(places)] + [(0, 0, "O|x", 900, "c", None, 0.0, 0.0)]
    rows = edges_allocentric(spark.createDataFrame(points, SCHEMA)).collect()
    assert {(r.source, r.target, r.ord_minor) for r in rows} == brute(points[:-1], 3, 1.5)


def test_a_wide_step_is_searched_cell_by_cell(spark):
    """Objects of one step, a metre apart: what an object looks through does not grow with the step."""
    from pyspark.sql import functions as F

    from roamframe.operators import edges

    looked = {}
    for n in (20, 40):
        points = [(0, 0, f"O|{i}", i, "c", float(i % n), 0.0, float(i // n)) for i in range(n * n)]
        df = spark.createDataFrame(points, SCHEMA)
        cells = df.select(F.explode(edges._cells(["local_x", "local_y", "local_z"], 6.0, 1.5)).alias("cell"))
        looked[n] = cells.groupBy("cell").count().agg(F.max("count")).first()[0]
        assert cells.count() <= 8 * n * n
    # A cell reaches over nine metres each way at most, however large the step is.
    assert looked == {20: 81, 40: 81}


@pytest.mark.parametrize("array_objects", [1, 128])
def test_repeated_rows_are_neighbours_as_often(spark, array_objects):
    """A repeated row fills as many places among the nearest, and its own are repeated too."""
    points = [(0, 0, "A", 0, "c", 0.0, 0.0, 0.0), *[(0, 0, "B", 1, "c", 0.5, 0.0, 0.0)] * 2, (0, 0, "C", 2, "c", 1.0, 0.0, 0.0)]
    rows = edges_allocentric(spark.createDataFrame(points, SCHEMA), array_objects=array_objects).collect()
    got = {s: [r.target for r in sorted(rows, key=lambda r: r.ord_minor) if r.source == s] for s in "ABC"}
    assert got == {"A": ["B", "B", "C"], "B": ["A", "A", "C"], "C": ["B", "B", "A"]}
