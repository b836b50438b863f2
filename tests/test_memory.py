import random

from pyspark.sql import functions as F

from helpers import step, tables

from roamframe.operators import edges, memory
from roamframe.operators.poses import visible_objects


def test_memory_of_a_known_episode(spark):
    """One episode worked out by hand: a gap in the steps, a shelf change out of view, a state at no step."""
    steps_ = [step("a", n, pos=i) for i, n in enumerate((2, 3, 7, 8))] + [step("b", 5, pos=0), step("b", 6, pos=1)]
    objects = [("Vase|1", "Vase", (1, 0, 0)), ("Sofa|2", "Sofa", (2, 0, 0)), ("Coat|3", "Coat", (3, 0, 0))]
    det = [("a", 2, 0, "Vase|1"), ("a", 2, 1, "Sofa|2"), ("a", 7, 0, "Sofa|2"), ("b", 5, 0, "Coat|3")]
    # The vase moves at step 3, at step 5 (never logged) and at step 8; the coat only before it is seen.
    states_ = [("a", 3, "Vase|1", "Vase", (40, 0, 0), "Shelf|1"), ("a", 5, "Vase|1", "Vase", (50, 0, 0), None),
               ("a", 8, "Vase|1", "Vase", (80, 0, 0), None), ("b", 4, "Coat|3", "Coat", (90, 0, 0), None)]
    t = tables(spark, steps_, det, objects, states_)
    gone = memory.non_visible_objects(memory.object_memory(t.steps, t.visible, t.states)).collect()
    got = {(r.episode_id, r.step, r.object_id, r.pos_x, r.last_seen, r.parent_receptacle) for r in gone}
    assert got == {
        ("a", 3, "Vase|1", 40.0, 2, "Shelf|1"),
        ("a", 3, "Sofa|2", 2.0, 2, None),
        ("a", 7, "Vase|1", 40.0, 2, "Shelf|1"),
        ("a", 8, "Vase|1", 80.0, 2, None),
        ("a", 8, "Sofa|2", 2.0, 7, None),
        ("b", 6, "Coat|3", 3.0, 5, None),
    }


def test_memory_of_random_episodes_keeps_its_terms(spark):
    """What is remembered at a step was seen before, is not in view, and carries its last sighting."""
    rng = random.Random(11)
    names = [f"O|{i}" for i in range(8)]
    steps_, det, seen = [], [], {}
    for ep in ("a", "b", "long"):
        numbers = sorted(rng.sample(range(300), 120 if ep == "long" else 12))
        steps_ += [step(ep, n, pos=i) for i, n in enumerate(numbers)]
        for n in numbers:
            seen[ep, n] = rng.sample(names, rng.choice([0, 0, 1, 3]))
            det += [(ep, n, i, o) for i, o in enumerate(seen[ep, n])]
    t = tables(spark, steps_, det, [(o, "Cup", (i, 0, 0)) for i, o in enumerate(names)], [])
    gone = memory.non_visible_objects(memory.object_memory(t.steps, t.visible, t.states)).collect()
    rows = {(r.episode_id, r.step, r.object_id): (r.last_seen, r.pos_x) for r in gone}
    assert len(rows) == len(gone)
    for ep, n in seen:
        for i, o in enumerate(names):
            before = [m for e, m in seen if e == ep and m < n and o in seen[e, m]]
            wanted = (max(before), float(i)) if before and o not in seen[ep, n] else None
            assert rows.get((ep, n, o)) == wanted
    by_key = memory.memory_minus_visible(memory.remember(t.spans, t.steps), t.visible)
    assert by_key.count() == len(rows)


def test_wanted_rows_are_the_same_rows(spark):
    rng = random.Random(31)
    steps = spark.createDataFrame([("e", n, 0.0) for n in range(300)], "episode_id string, step int, cam_x double")
    rows = []
    for name in ("Cup|1", "Jar|2", "Box|3"):
        at = sorted(rng.sample(range(300), 12))
        for a, b in zip(at, [*at[1:], None]):
            rows.append(("e", name, a, b, a))
    spans = spark.createDataFrame(
        rows, "episode_id string, object_id string, from_step int, next_step int, last_seen int"
    ).withColumns({c: F.lit(0) for c in ("from_pos", "next_pos", "seen_x", "seen_y", "seen_z")})
    asked = [("e", rng.randrange(300), rng.choice(["Cup|1", "Jar|2", "Box|3", "Hat|9"])) for _ in range(80)]
    wanted = spark.createDataFrame(asked, "episode_id string, step int, object_id string")
    got = memory.remember(spans, steps, wanted)
    every = memory.remember(spans, steps).join(wanted, ["episode_id", "step", "object_id"], "left_semi")
    plain = lambda df: sorted((r.step, r.object_id, r.last_seen) for r in df.collect())
    assert plain(got) == plain(every) and len(plain(got)) > 30


def test_repeated_detection_keeps_first_place_and_last_box(spark):
    t = tables(
        spark,
        [step("a", 0)],
        objects=[("Cup|1", "Cup", (0, 0, 1)), ("Mug|1", "Mug", (0, 0, 2))],
    )
    rows = [("a", 0, 0, "Cup|1", 1, 1, 5, 5), ("a", 0, 1, "Mug|1", 2, 2, 6, 6), ("a", 0, 2, "Cup|1", 3, 3, 7, 7),
            ("a", 0, 3, "Ghost|1", 3, 3, 7, 7)]
    det = spark.createDataFrame(rows, t.detections.schema)
    got = {r.object_id: (r.det_ord, r.cmin) for r in visible_objects(t.steps, det, t.states, t.objects).collect()}
    assert got == {"Cup|1": (0, 3), "Mug|1": (1, 2)}


def test_exact_state_wins_over_catalog(spark):
    t = tables(
        spark,
        [step("a", 0), step("a", 1)],
        [("a", 0, 0, "Cup|1"), ("a", 1, 0, "Cup|1")],
        [("Cup|1", "Cup", (0, 0, 1))],
        [("a", 1, "Cup|1", "Mug", (0, 0, 3), "Shelf|1")],
    )
    got = {r.step: (r.category, r.pos_z, r.local_z, r.parent_receptacle) for r in t.visible.collect()}
    assert got == {0: ("Cup", 1.0, 1.0, None), 1: ("Mug", 3.0, 3.0, "Shelf|1")}


def test_inferred_edge_uses_the_pose_of_the_step(spark):
    t = tables(
        spark,
        [step("a", 0), step("a", 1, yaw=90)],
        [("a", 0, 0, "Cup|1")],
        [("Cup|1", "Cup", (0, 0, 0.8))],
    )
    gone = memory.non_visible_objects(memory.object_memory(t.steps, t.visible, t.states))
    r = edges.edges_inferred(gone).collect()
    assert len(r) == 1
    e = r[0]
    assert (e.step, e.target, e.angle_x, e.last_seen, e.visible, e.inferred) == (1, "Cup|1", "left", 0, False, True)
    assert (e.distance_metric, e.distance_label) == (0.8, "nearby")
