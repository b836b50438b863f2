"""Checks and measures over facts and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.functions import geometry as G
from roamframe.functions.clean import is_movement
from roamframe.functions.text import ego_label, receptacle_phrase
from roamframe.operators.aggregates import displaced_ids, last_region_labels, visited_regions
from roamframe.operators.memory import non_visible_objects, remember
from roamframe.operators.paths import region_path_bfs
from roamframe.operators.poses import STEP, local_position, point
from roamframe.operators.routes import action_runs, region_segments
from roamframe.ordered import running_sum, step_block, with_ordered
from roamframe.params import DEFAULTS, Params
from roamframe.plans.facts import ARROW, walked_segments
from roamframe.plans.items import question_text
from roamframe.plans.tables import EpisodeTables
from roamframe.storage import saved

FACT = ["episode_id", "fact_no"]


def _ego_labels(t: EpisodeTables, step_col: str, params: Params) -> DataFrame:
    return t.visible.select(
        "episode_id",
        F.col("step").alias(step_col),
        F.col("object_id").alias("queried_object_id"),
        ego_label(G.direction_triplet(point("local"), params)).alias("again"),
    )


def validate_items(items: DataFrame, t: EpisodeTables, params: Params = DEFAULTS) -> DataFrame:
    """Each item's answer worked out again from poses, tracks and layout, and whether it agrees."""
    # Stored, as every construct below reads the items: drafting them seven times is most of the work.
    asked = items.where(F.col("answer").isNotNull()).select(
        "episode_id",
        "scene_id",
        "item_id",
        "construct",
        "queried_object_id",
        "query_step",
        "encoding_step",
        F.element_at("options", F.col("answer")).alias("answer_label"),
        "answer_source",
        "displacement_event",
    )
    asked = saved(asked, "asked")
    out = ["episode_id", "item_id", "construct", "answer_label", "again"]

    def of(construct: str) -> DataFrame:
        return asked.where(F.col("construct") == construct)

    now = of("egocentric_encoding").join(
        _ego_labels(t, "query_step", params),
        ["episode_id", "query_step", "queried_object_id"],
        "left",
    )
    then = of("spatial_working_memory").join(
        _ego_labels(t, "encoding_step", params),
        ["episode_id", "encoding_step", "queried_object_id"],
        "left",
    )
    updating = of("spatial_updating")
    poses = t.steps.join(
        updating.select("episode_id", F.col("query_step").alias("step")).distinct(),
        STEP,
        "left_semi",
    )
    local = G.round_pose(local_position(params), 3)
    # Only what is asked for is remembered step by step.
    about = updating.select("episode_id", F.col("queried_object_id").alias("object_id")).distinct()
    spans = t.spans.join(about, ["episode_id", "object_id"], "left_semi")
    bearing = (
        non_visible_objects(remember(spans, poses))
        .withColumn("__l", local)
        .select(
            "episode_id",
            F.col("step").alias("query_step"),
            F.col("object_id").alias("queried_object_id"),
            ego_label(G.direction_triplet(F.col("__l"), params)).alias("again"),
        )
    )
    updated = updating.join(bearing, ["episode_id", "query_step", "queried_object_id"], "left")
    named = F.regexp_extract(F.col("answer_source")[0], r"source=(.*),target=", 1)
    triplet = F.struct(*[F.col(f"angle_{a}").alias(a) for a in "xyz"])
    between = t.allocentric.select(
        "episode_id",
        F.col("step").alias("query_step"),
        F.col("target").alias("queried_object_id"),
        F.col("source").alias("reference"),
        ego_label(triplet).alias("again"),
    )
    related = of("allocentric_encoding").withColumn("reference", named).join(
        between, ["episode_id", "query_step", "queried_object_id", "reference"], "left"
    )
    # An event's name may be missing or occur twice: its step and object say which one is meant.
    which = ["event_id", "at_timestep", "object_id"]
    events = t.events.dropDuplicates(["episode_id", *which]).select(
        "episode_id",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in which],
        receptacle_phrase(F.col("to_receptacle")).alias("again"),
    )
    moved = of("invisible_displacement").withColumns(
        {f"__{c}": F.coalesce(F.col(f"displacement_event.{c}").cast("string"), F.lit("")) for c in which}
    )
    moved = moved.join(events, ["episode_id", *[f"__{c}" for c in which]], "left")
    runs = action_runs(walked_segments(t)).select(
        "episode_id",
        F.col("t0").alias("encoding_step"),
        F.array_join("turn_labels", ARROW).alias("again"),
    )
    walked = of("route_knowledge").join(runs, ["episode_id", "encoding_step"], "left")
    pair = F.regexp_extract(F.col("answer_source")[1], r"plan_path\[(.*)\]=", 1)
    planned = of("survey_knowledge").withColumns(
        {"start": F.split(pair, "→")[0], "goal": F.split(pair, "→")[1]}
    )
    labels = last_region_labels(t.regions).withColumnRenamed("region_id", "hop")
    first = (
        region_path_bfs(t.connectivity, planned.select("scene_id", "start", "goal").distinct())
        .where(F.size("path_regions") >= 2)
        .withColumn("hop", F.col("path_regions")[1])
        .join(labels, ["scene_id", "hop"], "left")
        .select(
            "scene_id",
            "start",
            "goal",
            F.concat(
                F.lit("use "), F.col("passages")[0], F.lit(" toward "), F.coalesce("region_label", "hop")
            ).alias("again"),
        )
    )
    planned = planned.join(first, ["scene_id", "start", "goal"], "left")
    parts = [now, then, updated, related, moved, walked, planned]
    all_ = parts[0].select(*out)
    for p in parts[1:]:
        all_ = all_.unionByName(p.select(*out))
    return all_.withColumn("agrees", F.col("answer_label").eqNullSafe(F.col("again")))


def _seen(t: EpisodeTables, step_col: str, name: str) -> DataFrame:
    return t.visible.select(
        "episode_id",
        F.col("step").alias(step_col),
        F.col("object_id").alias("queried_object_id"),
        F.lit(True).alias(name),
    )


def _walked_so_far(t: EpisodeTables) -> DataFrame:
    """Movements and degrees turned up to each step."""
    moves = is_movement(F.col("action")).cast("int")
    turned = F.when(
        F.lower("action").rlike("rotate|turn"), F.coalesce(F.col("degrees").cast("double"), F.lit(0.0))
    ).otherwise(0.0)
    return with_ordered(
        t.steps.select(*STEP, moves.alias("m"), turned.alias("d")),
        ["episode_id"],
        ["step"],
        step_block("step"),
        {"moves": running_sum("m"), "turned": running_sum("d")},
    ).select(*STEP, "moves", "turned")


def _with_walk(facts: DataFrame, t: EpisodeTables) -> DataFrame:
    """Movements and degrees turned in (encoding step, query step]."""
    so_far = _walked_so_far(t)
    out = facts
    for col, tag in (("encoding_step", "a"), ("query_step", "b")):
        at = so_far.select(
            "episode_id",
            F.col("step").alias(col),
            F.col("moves").alias(f"__m{tag}"),
            F.col("turned").alias(f"__d{tag}"),
        )
        out = out.join(at, ["episode_id", col], "left")
    return out.withColumns(
        {
            "num_movements": F.col("__mb") - F.col("__ma"),
            "total_rotation_degrees": F.col("__db") - F.col("__da"),
        }
    ).drop("__ma", "__mb", "__da", "__db")


def novel_path_check(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """Survey facts and whether their two regions were never walked one after the other."""
    pairs = segments.select(
        "episode_id",
        F.col("source_region_id").alias("__from"),
        F.col("goal_region_id").alias("__to"),
        F.lit(True).alias("__walked"),
    ).distinct()
    survey = facts.where(
        (F.col("construct") == "survey_knowledge") & (F.col("status") != "unsupported")
    ).withColumns(
        {"__from": F.col("path_regions")[0], "__to": F.element_at("path_regions", -1)}
    )
    return (
        survey.join(pairs, ["episode_id", "__from", "__to"], "left")
        .withColumn("novel", F.col("__walked").isNull())
        .drop("__from", "__to", "__walked")
    )


def must_hold_checks(facts: DataFrame, t: EpisodeTables) -> DataFrame:
    """One row per fact and rule of its construct, and whether the rule holds."""
    ready = facts.where(F.col("status") != "unsupported").withColumn(
        "__question", F.lower(question_text())
    )
    moved = displaced_ids(t.events).select(
        "episode_id", F.col("object_id").alias("queried_object_id"), F.lit(True).alias("__moved")
    )
    first_seen = t.visible.groupBy(
        "episode_id", F.col("object_id").alias("queried_object_id")
    ).agg(F.min("step").alias("__first"))
    novel = novel_path_check(facts, region_segments(t.region_changes)).select(*FACT, "novel")
    key = ["episode_id", "queried_object_id"]
    wide = (
        _with_walk(ready, t)
        .join(_seen(t, "query_step", "__now"), ["episode_id", "query_step", "queried_object_id"], "left")
        .join(moved, key, "left")
        .join(first_seen, key, "left")
        .join(novel, FACT, "left")
    )
    other = t.visible.select(
        "episode_id",
        F.col("step").alias("query_step"),
        F.col("object_id").alias("reference_object_id"),
        F.lit(True).alias("__other"),
    )
    path = region_segments(t.region_changes).select(
        "episode_id",
        F.col("t0").alias("encoding_step"),
        F.col("t1").alias("query_step"),
        F.lit(True).alias("__path"),
    )
    covered = visited_regions(t.region_changes).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("__regions")
    )
    wide = (
        wide.join(other.distinct(), ["episode_id", "query_step", "reference_object_id"], "left")
        .join(path.distinct(), ["episode_id", "encoding_step", "query_step"], "left")
        .join(covered, "episode_id", "left")
    )
    now, displaced = F.col("__now").isNotNull(), F.col("__moved").isNotNull()
    leak = F.contains("__question", F.lower("answer_label"))
    # Movements after the first step of the segment, up to its end.
    rules: dict[str, list[tuple[str, Column]]] = {
        "egocentric_encoding": [
            ("visible_in_view", now),
            ("no_delay", F.col("query_step") == F.col("encoding_step")),
        ],
        "spatial_working_memory": [("not_in_final_view", ~now), ("never_displaced", ~displaced)],
        "invisible_displacement": [
            ("hidden_during", F.coalesce("displacement_event.hidden_during", F.lit(True))),
            ("not_in_final_view", ~now),
            ("seen_before_move", F.coalesce(F.col("__first") < F.col("encoding_step"), F.lit(False))),
        ],
        "spatial_updating": [
            ("never_displaced", ~displaced),
            ("moved_in_between", F.coalesce(F.col("num_movements") > 0, F.lit(False))),
            ("not_in_final_view", ~now),
        ],
        "allocentric_encoding": [
            ("both_visible_in_view", now & F.col("__other").isNotNull()),
            ("no_delay", F.col("query_step") == F.col("encoding_step")),
        ],
        "route_knowledge": [
            ("several_movements", F.coalesce(F.col("num_movements") >= 2, F.lit(False))),
            ("path_was_walked", F.col("__path").isNotNull()),
        ],
        "survey_knowledge": [
            ("never_walked", F.coalesce("novel", F.lit(False))),
            ("several_regions_covered", F.coalesce(F.col("__regions") >= 2, F.lit(False))),
        ],
    }
    checks = [
        F.struct(F.lit("answer_not_in_question").alias("rule"), (~leak).alias("holds")),
        F.struct(
            F.lit("answer_traces_to_source").alias("rule"), (F.size("answer_source") > 0).alias("holds")
        ),
    ]
    for construct, own in rules.items():
        for rule, holds in own:
            checks.append(
                F.when(
                    F.col("construct") == construct,
                    F.struct(F.lit(rule).alias("rule"), holds.alias("holds")),
                )
            )
    return wide.select(
        *FACT, "construct", F.explode(F.array_compact(F.array(*checks))).alias("c")
    ).select(*FACT, "construct", "c.rule", "c.holds")


def violations(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("holds"))


def seen_count_before_k(t: EpisodeTables, k: int) -> DataFrame:
    """Distinct objects per type seen up to ``k`` steps before the last one."""
    last = t.steps.groupBy("episode_id").agg((F.max("step") - k).alias("__until"))
    # Pairs are reduced before the episode join, which keeps that join small.
    first = t.visible.groupBy("episode_id", "category", "object_id").agg(F.min("step").alias("s"))
    return (
        first.join(last, "episode_id")
        .where(F.col("s") <= F.col("__until"))
        .groupBy("episode_id", "category")
        .agg(F.count(F.lit(1)).alias("n_seen"))
    )


def difficulty_features(facts: DataFrame, t: EpisodeTables) -> DataFrame:
    """What makes a fact hard: relocations, movements, rotation, delay, competitors in view."""
    ready = facts.where(F.col("status") != "unsupported")
    moves = t.events.groupBy("episode_id", F.col("object_id").alias("queried_object_id")).agg(
        F.count(F.lit(1)).alias("num_relocations")
    )
    shown = t.visible.groupBy("episode_id", F.col("step").alias("query_step")).agg(
        F.count(F.lit(1)).alias("__shown")
    )
    return (
        _with_walk(ready, t)
        .join(moves, ["episode_id", "queried_object_id"], "left")
        .join(shown, ["episode_id", "query_step"], "left")
        .join(_seen(t, "query_step", "__now"), ["episode_id", "query_step", "queried_object_id"], "left")
        .select(
            *FACT,
            "construct",
            F.coalesce("num_relocations", F.lit(0)).alias("num_relocations"),
            "num_movements",
            "total_rotation_degrees",
            (F.col("query_step") - F.col("encoding_step")).alias("steps_since_seen"),
            (
                F.coalesce("__shown", F.lit(0)) - F.when(F.col("__now"), 1).otherwise(0)
            ).alias("num_visible_competitors"),
        )
    )


def freeze_filter(items: DataFrame) -> DataFrame:
    """Items that need vision: both text-only baselines fail them."""
    both_fail = ~F.col("blind_llm_correct") & ~F.col("caption_llm_correct")
    return items.where(F.coalesce("vision_necessary", both_fail, F.lit(False)))


def score_breakdown(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Exact-match accuracy per construct and per construct and frame of reference."""
    scored = items.where(F.col("answer").isNotNull()).join(
        responses, ["episode_id", "item_id"], "left"
    )
    hit = F.coalesce(F.col("choice") == F.col("answer"), F.lit(False)).cast("int")
    construct, frame = F.col("construct"), F.col("frame_of_reference")
    return scored.groupingSets([[construct], [construct, frame]], construct, frame).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(hit).alias("accuracy")
    )
