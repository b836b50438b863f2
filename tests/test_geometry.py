import math
import random

import pytest
from pyspark.sql import functions as F

from roamframe.functions import geometry as G
from roamframe.functions import text
from roamframe.params import DEFAULTS


def xyz(*v):
    return G.xyz(*[F.lit(float(x)) for x in v])


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


H = math.sqrt(2) / 2
POSES = [
    # pitch, yaw, world point, camera-frame point
    (0, 0, (0, 0, 1), (0, 0, 1)),
    (0, 0, (1, 0, 0), (1, 0, 0)),
    (0, 0, (0, -1, 0), (0, -1, 0)),
    (0, 90, (0, 0, 1), (-1, 0, 0)),
    (0, 90, (1, 0, 0), (0, 0, 1)),
    (0, 180, (0, 0, -1), (0, 0, 1)),
    (0, 270, (0, 0, 1), (1, 0, 0)),
    (0, -90, (1, 0, 0), (0, 0, -1)),
    (0, 360, (0, 0, 1), (0, 0, 1)),
    (-90, 0, (0, 0, 1), (0, -1, 0)),
    (-90, 0, (0, 1, 0), (0, 0, 1)),
    (45, 0, (0, 0, 1), (0, H, H)),
    (45, 0, (0, 1, 0), (0, H, -H)),
    (-45, 0, (0, 1, 0), (0, H, H)),
    (90, 0, (0, 1, 0), (0, 0, -1)),
    (45, 90, (0, 0, 1), (-1, 0, 0)),
]


def test_world_to_local_table(spark):
    rows = [(i, float(p), float(y), *map(float, w)) for i, (p, y, w, _) in enumerate(POSES)]
    df = spark.createDataFrame(rows, "i int, p double, y double, a double, b double, c double")
    local = G.world_to_local(xyz(0, 0, 0), F.col("p"), F.col("y"), G.xyz(F.col("a"), F.col("b"), F.col("c")))
    got = {r.i: (r.l.x, r.l.y, r.l.z) for r in df.select("i", local.alias("l")).collect()}
    for i, (_, _, _, want) in enumerate(POSES):
        assert got[i] == pytest.approx(want, abs=1e-9), POSES[i]


def test_camera_offset_and_distance(spark):
    a = G.world_to_local(xyz(-4, 0.5, 7), F.lit(0.0), F.lit(0.0), xyz(-4, 0.5, 9.5))
    b = G.world_to_local(xyz(0, 0, 0), F.lit(30.0), F.lit(45.0), xyz(3, 4, 5))
    r = one(spark, a.alias("a"), G.norm(b["x"], b["y"], b["z"]).alias("n"))
    assert (r.a.x, r.a.y, r.a.z) == (0, 0, 2.5)
    assert r.n == pytest.approx(math.sqrt(50))


def test_projection_limit(spark):
    p = [G.project_pinhole(xyz(0, 0, z)).alias(f"p{i}") for i, z in enumerate((1, 0.15, 0.150001, -1))]
    r = one(spark, *p)
    assert (r.p0.u, r.p0.v) == (198, 112)
    assert r.p1 is None and r.p3 is None
    assert r.p2.u == pytest.approx(198)


def test_focal_lengths_agree(spark):
    k = G.camera_intrinsics()
    r = one(spark, *[k[n].alias(n) for n in ("fx", "fy", "cx", "cy")])
    assert r.fx == pytest.approx(r.fy)
    assert (r.cx, r.cy) == (198, 112)


@pytest.mark.parametrize(
    "d, want",
    [
        (0.0, "within reach"), (0.5, "within reach"), (0.5 + 1e-9, "nearby"), (1.0, "nearby"),
        (1.0 + 1e-9, "far"), (1.5, "far"), (1.5 + 1e-9, "beyond"), (10.0, "beyond"),
        (float("nan"), "beyond"),
    ],
)
def test_distance_label(spark, d, want):
    assert one(spark, G.distance_label(F.lit(d)).alias("l")).l == want


def test_axis_thresholds_are_strict(spark):
    for fn, pos, neg, t in (
        (G.axis_direction_x, "right", "left", 0.5),
        (G.axis_direction_y, "above", "below", 0.1),
        (G.axis_direction_z, "front", "behind", 0.5),
    ):
        values = (t, -t, t + 0.01, -t - 0.01, float("nan"))
        r = one(spark, *[fn(F.lit(v), t).alias(f"c{i}") for i, v in enumerate(values)])
        assert tuple(r) == ("", "", pos, neg, "")


def test_angle_dead_zones(spark):
    angles = (0.0, 180.0, -180.0, 14.9, 15.1, -15.1, 90.0)
    x = one(spark, *[G.x_direction_angle(F.lit(a), 15).alias(f"c{i}") for i, a in enumerate(angles)])
    assert tuple(x) == ("", "", "", "", "right", "left", "right")
    angles = (0.0, 180.0, 90.0, 74.9, 105.1)
    z = one(spark, *[G.z_direction_angle(F.lit(a), 15).alias(f"c{i}") for i, a in enumerate(angles)])
    assert tuple(z) == ("front", "behind", "", "front", "behind")


@pytest.mark.parametrize(
    "diff, want",
    [
        ((0, 0, 1), ("", "", "front")), ((1, 0, 1), ("right", "", "front")),
        ((-1, 0, -1), ("left", "", "behind")), ((0, 0.15, 1), ("", "above", "front")),
        ((0.01, 0, 1), ("", "", "front")), ((0, 0, -2), ("", "", "behind")),
        ((0, 0, 0), ("", "", "")), ((3, 0, 5), ("right", "", "front")),
        ((float("nan"),) * 3, ("left", "", "")),
    ],
)
def test_direction_triplet(spark, diff, want):
    t = one(spark, G.direction_triplet(xyz(*diff), DEFAULTS).alias("t")).t
    assert (t.x, t.y, t.z) == want


def test_round_exact_matches_python(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 20) for _ in range(3000)]
    values += [i / 200 for i in range(2000)] + [i / 8 for i in range(200)] + [2.675, 1.005, 0.125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", G.round_exact(F.col("v")).alias("r")).collect():
        assert r.r == round(r.v, 2), r.v


def test_ego_label_order(spark):
    cases = {
        ("left", "above", "front"): "to your left", ("right", "", "behind"): "to your right",
        ("", "below", "front"): "ahead of you", ("", "above", "behind"): "behind you",
        ("", "above", ""): "above you", ("", "below", ""): "below you", ("", "", ""): None,
    }
    for (x, y, z), want in cases.items():
        t = F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
        assert one(spark, text.ego_label(t).alias("l")).l == want


def test_min_corner_and_pose_rounding(spark):
    corners = F.array(xyz(1, 5, 3), xyz(0, 6, 4), xyz(2, 4, 9))
    r = one(spark, G.bbox_min_corner(corners).alias("m"), G.round_pose(xyz(1.005, 2.5, -0.001), 2).alias("p"))
    assert (r.m.x, r.m.y, r.m.z) == (0, 4, 3)
    assert str(r.p.z) == "0.0"
