"""What is moved between tasks once tables are too large to be broadcast."""

import pytest

from helpers import step, tables

from roamframe.operators import assemble, edges, memory, poses
from roamframe.plans import checks, facts, items
from roamframe.sources import store
from roamframe.storage import saved


@pytest.fixture
def large(spark):
    """No side of a join counts as small, and no plan changes while it runs."""
    asked = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df):
    """Shuffles of the plan; one that is used again counts once."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in lines)


@pytest.fixture(scope="module")
def t(spark):
    rows = [step("a", n) for n in range(6)] + [step("b", n) for n in range(4)]
    objects = [("Cup|1", "Cup", (1, 0, 2)), ("Mug|2", "Mug", (-1, 0, 2)), ("Pot|3", "Pot", (3, 0, 1))]
    seen = [("a", 0, 0, "Cup|1"), ("a", 0, 1, "Mug|2"), ("a", 3, 0, "Cup|1"), ("b", 1, 0, "Pot|3"), ("b", 1, 1, "Cup|1")]
    moved = [("a", n, "Cup|1", "Cup", (1 + n, 0, 2), f"Shelf|{n}") for n in range(6)]
    # A state without an object, and one of a step that is not logged.
    moved += [("a", 3, None, "Cup", (9, 0, 9), None), ("a", 77, "Cup|1", "Cup", (8, 0, 8), None)]
    return tables(spark, rows, seen, objects, moved)


def test_objects_meet_their_states_and_cameras_in_two_shuffles(t, large):
    """Detections with states, and steps; the third is for the catalog, and the rows that look into it."""
    found = poses.visible_objects(t.steps, t.detections, t.states, t.objects)
    assert exchanges(found) <= 4
    got = {(r.episode_id, r.step, r.object_id, r.pos_x, r.from_state, r.parent_receptacle) for r in found.collect()}
    assert got == {
        ("a", 0, "Cup|1", 1.0, True, "Shelf|0"), ("a", 0, "Mug|2", -1.0, False, None),
        ("a", 3, "Cup|1", 4.0, True, "Shelf|3"), ("b", 1, "Pot|3", 3.0, False, None),
        ("b", 1, "Cup|1", 1.0, False, None),
    }


def test_repeated_states_repeat_their_objects(t, spark):
    twice = t.states.unionByName(t.states)
    found = poses.visible_objects(t.steps, t.detections, twice, t.objects)
    assert found.where("object_id = 'Cup|1' and episode_id = 'a'").count() == 4
    assert found.count() == 7


def test_marks_of_an_object_are_dealt_once(t, large):
    """States to steps, marks to blocks, and the summaries of blocks."""
    spans = memory.memory_spans(t.steps, t.visible, t.states)
    assert exchanges(spans) <= 5
    got = {(r.object_id, r.from_step, r.next_step, r.pos_x) for r in spans.where("episode_id = 'a'").collect()}
    cup = {("Cup|1", n, n + 1 if n < 5 else None, 1.0 + n) for n in range(6)}
    assert got == cup | {("Mug|2", 0, None, -1.0)}


def test_facts_move_once_to_their_images(t, large):
    picked = facts.plan_egocentric.views(t)
    with_images = facts.with_images(picked, t.steps)
    # Asked steps (by step, then by episode), the log, and the facts, which lie by episode then.
    assert exchanges(with_images) <= 4
    plan = with_images._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in line and "construct" in line for line in plan.splitlines())
    assert {tuple(r.image_paths) for r in with_images.where("episode_id = 'b'").collect()} == {("img_1.png",)}


def test_items_are_drafted_once_to_be_validated(t, spark):
    drafted = items.draft_items(facts.plan_all(t), t)
    checked = checks.validate_items(drafted, t)
    text = checked._jdf.queryExecution().optimizedPlan().toString()
    # Wording needs the facts; what is left reads the stored items.
    assert "distractor_seeds" not in text and "options_pool" not in text
    assert checked.count() == drafted.where("answer is not null").count()
    assert checked.where("not agrees").count() == 0


def _nested_sides(t):
    gone = memory.non_visible_objects(memory.remember(t.spans, t.steps))
    objects = saved(memory.union_objects(t.visible, gone), "objects")
    related = saved(edges.union_edges(edges.edges_egocentric(t.visible), edges.edges_inferred(gone)), "edges")
    return objects, related


def test_nested_steps_are_dealt_once(t, large):
    objects, related = _nested_sides(t)
    nested = assemble.assemble_steps(t.steps, objects, related)
    assert exchanges(nested) == 1
    got = {(r.episode_id, r.step): r for r in nested.collect()}
    assert len(got) == 10
    assert list(got["a", 0].visible_objects) == ["Cup|1", "Mug|2"]
    assert [e.target for e in got["a", 1].edges_inferred] == ["Cup|1", "Mug|2"] and got["a", 1].edges_egocentric == []
    # A step with neither objects nor edges.
    assert got["b", 0].visible_objects is None and got["b", 0].edges_inferred is None


def test_asked_episodes_are_loaded_whole(t, large, tmp_path, monkeypatch):
    objects, related = _nested_sides(t)
    others = t.episodes.selectExpr("'none' as episode_id", "scene_id", "environment").limit(1)
    tables = {
        "episodes": t.episodes.unionByName(others), "steps": t.steps, "step_objects": objects, "edges": related,
    }
    path = str(tmp_path / "store")
    store.write_episodes(tables, path, buckets=2, dealt=("step_objects", "edges"))
    back = {n: store.read_table(large, path, n) for n in tables}
    assert back["edges"].count() == related.count() and back["step_objects"].count() == objects.count()
    ids = large.createDataFrame([("a",), ("none",), ("a",)], "episode_id string")
    for few in (10, 0):
        monkeypatch.setattr(store, "FEW_IDS", few)
        nested = store.load_episode(back, ids, 2)
        got = {r.episode_id: r for r in nested.collect()}
        assert set(got) == {"a", "none"}
        assert got["none"].steps is None and got["none"].part is None and got["none"].scene_id == "house_1"
        assert [s.step for s in got["a"].steps] == list(range(6))
        assert list(got["a"].steps[3].non_visible_objects) == ["Mug|2"]
    # An episode that is stored twice is loaded twice.
    twice = store.load_episode({**back, "episodes": back["episodes"].unionByName(back["episodes"])}, ids)
    assert sorted((r.episode_id, len(r.steps or [])) for r in twice.collect()) == [("a", 6)] * 2 + [("none", 0)] * 2


def test_dealt_tables_are_written_without_a_shuffle(t, large, tmp_path):
    """Rows of one task are one file per bucket; a shuffle would have gathered the buckets."""
    steps = saved(t.steps.repartition(3), "steps")
    store.write_episodes(
        {"episodes": t.episodes, "steps": steps}, str(tmp_path / "s"), buckets=1, dealt=("steps",)
    )
    assert len(list((tmp_path / "s" / "steps").rglob("*.parquet"))) == 3
    assert store.read_table(large, str(tmp_path / "s"), "steps").count() == 10


def test_json_exports_are_packed(t, spark, tmp_path):
    out = tmp_path / "json"
    store.export_json(t.steps, str(out))
    assert all(f.name.endswith(".json.gz") for f in out.glob("part-*"))
    back = store.read_episode(spark, json=str(out), schema=t.steps.schema)
    assert sorted(back.collect()) == sorted(t.steps.collect())


def test_facts_move_once_to_what_their_questions_describe(t, large):
    planned = saved(facts.plan_all(t), "facts")
    drafted = items.draft_items(planned, t)
    plan = drafted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # The answerable and the other facts each read the facts once; objects in view are not read again.
    assert sum("options_pool" in x and "Relation" in x for x in plan) == 2
    assert sum("Relation" in x and "cmin" in x for x in plan) == 0
