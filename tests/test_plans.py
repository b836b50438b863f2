"""What the plans of heavy operators may contain, whatever the optimizer knows of the sizes."""

import re

import pytest
from helpers import step, tables

from roamframe.operators.routes import action_runs, segment_turns
from roamframe.plans import facts
from roamframe.storage import saved


def plan_of(spark, build):
    """The physical plan without broadcasts and without runtime changes."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def exchanges(plan):
    shuffles = re.sub(r"ReusedExchange.*", "", plan)
    return len(re.findall(r"(?:^|[ :+\-])Exchange ", shuffles, re.MULTILINE))


def scans(plan, name):
    return len(re.findall(rf"FileScan parquet .*{name}", plan))


@pytest.fixture(scope="module")
def stored(spark):
    from dataclasses import replace

    rooms = {0: "r0", 3: "r1", 5: "r2", 8: "r0"}
    steps = [step("a", i, room=rooms[max(r for r in rooms if r <= i)]) for i in range(12)]
    steps += [step("b", i, room="r0", action=None) for i in range(4)]
    t = tables(spark, steps, regions=[("r0", "Hall"), ("r1", None), ("r2", "Bath")], links=[("r0", "r1", "p", True), ("r1", "r2", None, True)])
    return replace(t, **{n: saved(getattr(t, n), f"test-{n}") for n in ("steps", "episodes", "regions", "connectivity", "landmarks")})


def test_route_reads_steps_three_times(spark, stored):
    plan = plan_of(spark, lambda: facts.plan_route(stored))
    assert exchanges(plan) <= 12
    assert scans(plan, "test-steps") <= 3
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_turns_of_segments_come_from_one_reading(spark, stored):
    turns = stored.steps.select("episode_id", "step", "action", "degrees")
    for build, most in ((lambda: segment_turns(stored.region_changes, turns), 3), (lambda: action_runs(facts.walked_segments(stored)), 4)):
        plan = plan_of(spark, build)
        assert exchanges(plan) <= most
        assert scans(plan, "test-steps") == 1
        assert "ReusedExchange" in plan


def test_images_of_all_planners_are_looked_up_once(spark, stored):
    names = ["egocentric_encoding", "allocentric_encoding", "route_knowledge", "perspective_taking"]
    plan = plan_of(spark, lambda: facts.plan_all(stored, names))
    assert len(re.findall(r"FileScan parquet \[[^\]]*image_path", plan)) == 1


def test_survey_has_no_product(spark, stored):
    plan = plan_of(spark, lambda: facts.plan_survey(stored))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
