import math
import random

import pytest

from roamframe.operators import tracks

STATE = (
    "episode_id int, object_id string, step int, category string, pos_x double, pos_y double, "
    "pos_z double, rot_x double, rot_y double, rot_z double, visible boolean, in_camera_fov boolean, "
    "parent_receptacle string, is_inside_receptacle boolean, receptacle_is_open boolean"
)
OBJECTS = (
    "object_id string, category string, pos_x double, pos_y double, pos_z double, rot_x double, "
    "rot_y double, rot_z double"
)


def state(step, x=2.5, seen=True, shelf="Shelf|4", thing="Lamp|7", category="Lamp", open_=None):
    """A state row of a lamp; what does not change in these tests is left out."""
    place = (x, 0.25, -3.0, 0.0, 45.0, 0.0)
    return (6, thing, step, category, *place, seen, seen, shelf, shelf is not None, open_)


@pytest.fixture
def track(spark):
    # Moved at 14, out of view from 17 on, off its shelf at 30, back at 31, opened at 32.
    series = [state(10), state(11), state(14, 2.75), state(15, 2.75), state(17, 2.75, False)]
    series += [state(22, 2.75, False), state(30, 2.75, False, None), state(31, 2.75, False), state(32, 2.75, False, open_=True)]
    return tracks.object_state_track(spark.createDataFrame(series, STATE), spark.createDataFrame([], OBJECTS))


def test_track_keeps_first_row_and_changes(track):
    assert sorted(r.step for r in track.collect()) == [10, 14, 17, 30, 31, 32]
    assert {r.category for r in track.collect()} == {"Lamp"}


def test_state_at_a_step(spark, track):
    wanted = [9, 10, 13, 14, 29, 30, 500, 500]
    asked = spark.createDataFrame([(6, "Lamp|7", s) for s in wanted], "episode_id int, object_id string, step int")
    got = sorted(((r.step, r.in_camera_fov, r.pos_x, r.parent_receptacle) for r in tracks.asof_state(track, asked).collect()), key=str)
    late = (500, False, 2.75, "Shelf|4")
    want = [(9, None, None, None), (10, True, 2.5, "Shelf|4"), (13, True, 2.5, "Shelf|4"), (14, True, 2.75, "Shelf|4")]
    want += [(29, False, 2.75, "Shelf|4"), (30, False, 2.75, None), late, late]
    assert got == sorted(want, key=str)


def test_region_series(spark):
    walked = [(3, "hall", "Hall"), (4, "hall", "Hall"), (9, "attic", "Attic"), (12, "hall", "Hall"), (13, "hall", "Hall")]
    df = spark.createDataFrame([(2, *w) for w in walked], "episode_id int, timestep int, region_id string, region_type string")
    kept = tracks.region_change_points(df)
    assert sorted(r.timestep for r in kept.collect()) == [3, 9, 12]
    asked = spark.createDataFrame([(2, s) for s in (2, 8, 11, 40)], "episode_id int, step int")
    got = {r.step: r.region_id for r in tracks.asof_series(kept, asked, unique=True).collect()}
    assert {s: r for s, r in got.items() if r} == {8: "hall", 11: "attic", 40: "hall"}


def test_missing_region_counts_every_time(spark):
    rows = [(0, 0, "a", None), (0, 1, None, None), (0, 2, None, None), (0, 3, "a", None), (0, 4, "a", None)]
    df = spark.createDataFrame(rows, "episode_id int, timestep int, region_id string, region_type string")
    assert sorted(r.timestep for r in tracks.region_change_points(df).collect()) == [0, 1, 2, 3]


def test_eps_points_of_known_series(spark):
    """Kept steps worked out by hand for eps 0.0001; a step holds part, step, x, flag, kept."""
    nan = math.nan
    series = {
        "drift": [(0, 0.0, "A", 1), (1, 0.00004, "A", 0), (2, 0.00008, "A", 0), (3, 0.00012, "A", 1), (4, 0.0002, "A", 0), (5, 0.00023, "A", 1)],
        "jump": [(2, 5.0, "A", 1), (7, 6.0, "A", 1), (8, 6.0, "A", 0), (9, 5.0, "A", 1)],
        "flag": [(0, 1.0, "A", 1), (1, 1.0, None, 1), (2, 1.0, None, 0), (3, 1.0, "A", 1)],
        "nan": [(0, 1.0, "A", 1), (1, nan, "A", 0), (2, 1.5, "A", 1), (3, nan, "B", 1), (4, 9.0, "B", 0), (5, nan, "A", 1)],
        "one": [(3, nan, None, 1)],
    }
    rows = [(p, s, x, f) for p, own in series.items() for s, x, f, _ in own]
    df = spark.createDataFrame(rows, "p string, step int, x double, flag string")
    want = sorted((p, s) for p, own in series.items() for s, _, _, kept in own if kept)
    for block_size in (2, 3, 4096):
        out = tracks.change_points_eps(df, ["p"], "step", ["x"], ["flag"], block_size=block_size)
        assert sorted((r.p, r.step) for r in out.collect()) == want, block_size


@pytest.mark.parametrize("block_size", [4, 7])
def test_eps_blocks_do_not_matter(spark, block_size):
    """Drift, jumps and standstill over many small blocks: as in one block, and by the rule's own terms."""
    rng = random.Random(block_size)
    rows = []
    for part in range(12):
        x = 0.0
        for step in range(rng.choice([1, 5, 150])):
            x += 3e-5 if part % 3 == 0 else rng.choice([0, 0, 2e-5, 6e-5, -4e-5, rng.uniform(-1, 1)])
            rows.append((part, step, x, rng.choice([None, "A", "A", "A", "A"])))
    df = spark.createDataFrame(rows, "p int, step int, x double, flag string")

    def kept(size):
        out = tracks.change_points_eps(df, ["p"], "step", ["x"], ["flag"], block_size=size)
        return sorted((r.p, r.step) for r in out.collect())

    small = kept(block_size)
    assert small == kept(4096)
    at = {(p, s): (x, f) for p, s, x, f in rows}
    for p, s in at:
        before = max((k for q, k in small if q == p and k <= s), default=None)
        # The last kept row at or before any row is that row itself, or within eps of it and flagged alike.
        assert before == s or (abs(at[p, before][0] - at[p, s][0]) <= 1e-4 and at[p, before][1] == at[p, s][1])


def test_drift_is_not_lag(spark):
    df = spark.createDataFrame([(0, i, i * 6e-5) for i in range(3)], "p int, step int, x double")
    kept = tracks.change_points_eps(df, ["p"], "step", ["x"], [])
    assert sorted(r.step for r in kept.collect()) == [0, 2]


def test_first_category_falls_back_to_catalog(spark):
    states = spark.createDataFrame([state(3, category="New"), state(1, category="Old")], STATE)
    objects = spark.createDataFrame([("Lamp|7", "Catalog", *[0.0] * 6)], OBJECTS)
    assert tracks.first_category(states, objects).collect()[0].category == "Old"
