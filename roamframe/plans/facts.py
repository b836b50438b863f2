"""Fact planners: which spatial facts of an episode are worth asking about.

A planner keeps the first ``n`` facts per episode in scan order.  The rank filters become window
group limits, which cut each map task to ``n`` rows per episode before anything is shuffled, and
images are looked up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamframe.functions import geometry as G
from roamframe.functions.clean import CONSTRUCT_NAMES, is_action
from roamframe.functions.options import BEARINGS, limit_images, limit_options, present, text_array
from roamframe.functions.text import display_name, ego_label, quoted_list, receptacle_phrase
from roamframe.operators.aggregates import (
    displaced_ids,
    receptacle_phrases,
    last_region_labels,
    visited_regions,
)
from roamframe.operators.edges import first_allocentric_edge
from roamframe.operators.memory import OBJECT
from roamframe.operators.paths import START, adjacency, rebuilt_paths, search_trees
from roamframe.operators.poses import STEP, local_position, point
from roamframe.operators.routes import (
    action_runs,
    exclude_displaced,
    next_movement,
    segment_turns,
)
from roamframe.ordered import row_number, step_block, with_ordered
from roamframe.params import DEFAULTS, Params
from roamframe.plans.tables import EpisodeTables
from roamframe.storage import cut, saved

FACT_COLUMNS = {
    "episode_id": None,
    "construct": "string",
    "status": "string",
    "rank": "int",
    "query_step": "int",
    "encoding_step": "int",
    "queried_object_id": "string",
    "reference_object_id": "string",
    "answer_label": "string",
    "answer_source": "array<string>",
    "image_paths": "array<string>",
    "options_pool": "array<string>",
    "distractor_seeds": "array<string>",
    "displacement_event": "struct<event_id:string,at_timestep:int,object_id:string,"
    "from_receptacle:string,to_receptacle:string,hidden_during:boolean>",
    "reason": "string",
    "object_type": "string",
    "reference_object": "string",
    "source": "string",
    "goal": "string",
    "pre_move_label": "string",
    "turn_labels": "array<string>",
    "path_regions": "array<string>",
    "passages": "array<string>",
}
NO_TEXTS = "array<string>"
# Options offered when an episode has few receptacles.
PLACES = ["on/in the Shelf", "on/in the Sofa", "on/in the Table", "on the floor"]
ROUTE_DECOY = "move_ahead ×2 → rotate_left 90°"
ARROW = " → "


def _facts(df: DataFrame, construct: str, status: Column | str, **columns: Column) -> DataFrame:
    """Rows in the shape of a facts table, and their views; columns not given are null, lists are empty."""
    given = {**columns, "construct": F.lit(construct)}
    views = given.pop("views", F.array()).cast(VIEWS).alias("views")
    given["status"] = F.lit(status) if isinstance(status, str) else status
    out = []
    for name, type_ in FACT_COLUMNS.items():
        if type_ is None:
            out.append(F.col(name))
        elif name in given:
            out.append(given[name].cast(type_).alias(name))
        elif name in ("image_paths", "options_pool", "distractor_seeds"):
            out.append(F.array().cast(NO_TEXTS).alias(name))
        else:
            out.append(F.lit(None).cast(type_).alias(name))
    return df.select(*out, views)


def _if(planned: Column, *texts: Column) -> Column:
    return F.when(planned, F.array(*texts))


def _texts(planned: Column, texts: Column) -> Column:
    return F.when(planned, texts).otherwise(F.array().cast(NO_TEXTS))


def top_n_facts(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows per episode, with their rank."""
    w = Window.partitionBy("episode_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def planner(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A planner whose facts have their images; ``plan.views`` gives them with their views instead."""

    @wraps(plan)
    def whole(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
        return with_images(plan(t, n, params), t.steps)

    whole.views = plan
    return whole


def union_facts(*facts: DataFrame) -> DataFrame:
    out = facts[0]
    for more in facts[1:]:
        out = out.unionByName(more)
    return out


VIEWS = "array<struct<step:int,image:string>>"


def _views(*views: str | Column) -> Column:
    """Images of a fact: names of step columns to look up, or known images."""
    step = lambda v: F.struct(F.col(v).cast("int").alias("step"), F.lit(None).cast("string").alias("image"))
    known = lambda v: F.struct(F.lit(None).cast("int").alias("step"), v.alias("image"))
    return F.array(*[step(v) if isinstance(v, str) else known(v) for v in views])


def with_images(facts: DataFrame, steps: DataFrame) -> DataFrame:
    """Facts with ``image_paths`` in place of ``views``; a step that is not in the log has no image.

    One lookup for the facts of all planners: the facts are stored, only the steps of their views are looked up, and
    what is found is one short list per episode, as its facts are few. So the facts themselves move once.
    Survey facts show each image once.
    """
    columns = [c for c in facts.columns if c != "views"]
    facts = saved(facts.drop("image_paths"), "picked")
    asked = facts.select("episode_id", F.explode("views.step").alias("step")).distinct()
    looked = asked.join(steps.select(*STEP, "image_path"), STEP).groupBy("episode_id").agg(
        F.collect_list(F.struct("step", "image_path")).alias("looked")
    )
    known = facts.repartition("episode_id").join(looked, "episode_id", "left").select(
        "episode_id",
        "construct",
        "rank",
        F.struct(*[c for c in columns if c != "image_paths"]).alias("fact"),
        "looked",
        F.posexplode_outer("views").alias("i", "view"),
    )
    found = F.filter("looked", lambda v: v["step"] == F.col("view.step"))
    # A step that is logged twice counts twice.
    known = known.withColumn("image", F.explode_outer(F.transform(found, lambda v: v["image_path"])))
    image = F.struct("i", F.coalesce("view.image", "image").alias("image"))
    whole = known.groupBy("episode_id", "construct", "rank").agg(
        F.first("fact").alias("fact"), F.sort_array(F.collect_list(image)).alias("images")
    )
    shown = F.transform("images", lambda v: v["image"])
    paths = F.when(F.col("construct") == "survey_knowledge", limit_images(shown)).otherwise(present(shown))
    return whole.withColumn("image_paths", paths).select(
        *[F.col("image_paths") if c == "image_paths" else F.col("fact")[c].alias(c) for c in columns]
    )


def _label(diff: Column, params: Params) -> Column:
    return ego_label(G.direction_triplet(diff, params))


def _source_text(step: Column, kind: str, target: Column) -> Column:
    return F.concat(
        F.lit("steps["),
        step.cast("string"),
        F.lit(f"].{kind}[target="),
        target,
        F.lit("].angle_relation"),
    )


@planner
def plan_egocentric(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
    """Each visible object that has a direction from the agent."""
    labelled = t.visible.select(
        *STEP, "det_ord", "object_id", "category", _label(point("local"), params).alias("label")
    ).where(F.col("label").isNotNull())
    picked = top_n_facts(labelled, n, ["step", "det_ord"])
    return _facts(
        picked,
        "egocentric_encoding",
        "ok",
        rank=F.col("rank"),
        query_step=F.col("step"),
        encoding_step=F.col("step"),
        queried_object_id=F.col("object_id"),
        answer_label=F.col("label"),
        answer_source=F.array(
            _source_text(F.col("step"), "edges_egocentric", F.col("object_id"))
        ),
        views=_views("step"),
        options_pool=text_array(BEARINGS),
        distractor_seeds=text_array(["opposite_direction", "orthogonal_direction"]),
        object_type=display_name(F.col("category"), F.col("object_id")),
    )


def _gaps(t: EpisodeTables, params: Params) -> DataFrame:
    """Sightings of never-displaced objects, each with the position of the next one.

    Objects without state rows have one memory span per sighting.  Without a next sighting the gap
    is open; positions past the end of the episode sort after all others and fall away when the step
    is looked up, so the end itself is not needed here.
    """
    return exclude_displaced(t.spans, displaced_ids(t.events)).select(
        *OBJECT,
        "last_seen",
        F.col("from_pos").alias("pos"),
        "next_pos",
        "category",
        *[f"pos_{a}" for a in "xyz"],
        _label(point("seen"), params).alias("seen_label"),
        F.struct("first_step", "first_det_ord").alias("mem"),
    )


def _walk(gaps: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """One row per position of [lo, hi]."""
    return (
        gaps.withColumns({"__lo": lo, "__hi": hi})
        .where(F.col("__hi") >= F.col("__lo"))
        .withColumn("query_pos", F.explode(F.sequence("__lo", "__hi")))
        .drop("__lo", "__hi")
    )


def _remembered_fact(df: DataFrame, construct: str, status: str, seeds: Column, **more) -> DataFrame:
    return _facts(
        df,
        construct,
        status,
        rank=F.col("rank"),
        query_step=F.col("step"),
        encoding_step=F.col("last_seen"),
        queried_object_id=F.col("object_id"),
        answer_label=F.col("label"),
        views=_views("last_seen", F.col("image")),
        options_pool=text_array(BEARINGS),
        distractor_seeds=seeds,
        object_type=display_name(F.col("category"), F.col("object_id")),
        **more,
    )


@planner
def plan_working_memory(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
    """Out-of-view objects that never moved; the answer is where they were when last seen.

    Within a gap the answer does not change, so only its first ``n`` steps can be among the first
    ``n`` facts of the episode; the step x object grid is not built.
    """
    gaps = _gaps(t, params).where(F.col("seen_label").isNotNull())
    rows = _walk(gaps, F.col("pos") + 1, F.least(F.col("next_pos") - 1, F.col("pos") + n))
    picked = top_n_facts(rows, n, ["query_pos", "mem"]).withColumnRenamed("seen_label", "label")
    here = t.steps.select(
        "episode_id", F.col("pos").alias("query_pos"), "step", F.col("image_path").alias("image")
    )
    picked = picked.join(here, ["episode_id", "query_pos"])
    return _remembered_fact(
        picked,
        "spatial_working_memory",
        "ok",
        text_array(["opposite_direction", "orthogonal_direction", "current_view_answer"]),
        answer_source=F.array(
            _source_text(F.col("last_seen"), "edges_egocentric", F.col("object_id"))
        ),
    )


def _bearing_now(rows: DataFrame, steps: DataFrame, params: Params) -> DataFrame:
    """Direction of the remembered position from the pose at the query position."""
    here = steps.select(
        "episode_id",
        F.col("pos").alias("query_pos"),
        "step",
        F.col("image_path").alias("image"),
        *[f"cam_{a}" for a in "xyz"],
        "pitch_deg",
        "yaw_deg",
    )
    placed = rows.join(here, ["episode_id", "query_pos"]).withColumn(
        "__local", G.round_pose(local_position(params), 3)
    )
    return placed.withColumn("label", _label(F.col("__local"), params)).drop("__local")


@planner
def plan_spatial_updating(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
    """As working memory, after a movement; the answer is the bearing from the pose now.

    The first ``n`` candidates of an episode are its facts unless one of them has no direction (the
    object is exactly at the camera).  Episodes where that happens walk their gaps in full.
    """
    moves = next_movement(t.steps).select(*STEP, "next_move")
    gaps = (
        _gaps(t, params)
        .withColumn("step", F.col("last_seen"))
        .join(moves, STEP)
        .drop("step")
        .where(F.col("next_move").isNotNull())
    )
    lo, hi = F.col("next_move"), F.col("next_pos") - 1
    first = top_n_facts(_walk(gaps, lo, F.least(hi, lo + n - 1)), n, ["query_pos", "mem"])
    # At most n rows per episode are stored here; without an unclear one the full walk has no rows.
    picked = cut(_bearing_now(first, t.steps, params))
    unclear = picked.where(F.col("label").isNull()).select("episode_id").distinct()
    ends = t.steps.groupBy("episode_id").agg(F.max("pos").alias("end"))
    whole = gaps.join(ends.join(unclear, "episode_id", "left_semi"), "episode_id")
    whole = _walk(whole, lo, F.coalesce(hi, F.col("end"))).drop("end")
    full = _bearing_now(whole, t.steps, params).where(F.col("label").isNotNull())
    full = top_n_facts(full, n, ["query_pos", "mem"])
    picked = picked.join(unclear, "episode_id", "left_anti").unionByName(full)
    earlier = F.when(F.col("seen_label") != F.col("label"), F.array("seen_label")).otherwise(
        F.array().cast(NO_TEXTS)
    )
    return _remembered_fact(
        picked,
        "spatial_updating",
        "thin",
        F.concat(earlier, text_array(["pre_move_bearing", "opposite_direction"])),
        answer_source=F.array(_source_text(F.col("step"), "edges_inferred", F.col("object_id"))),
        pre_move_label=F.col("seen_label"),
    )


@planner
def plan_invisible_displacement(
    t: EpisodeTables, n: int = 3, params: Params = DEFAULTS
) -> DataFrame:
    """Hidden relocations of objects that are not in view at the end."""
    last = t.steps.groupBy("episode_id").agg(
        F.max_by(F.struct("step", "image_path"), "step").alias("end")
    )
    hidden = t.events.where(
        F.coalesce(F.col("hidden_during"), F.lit(True))
        & (F.coalesce(F.col("object_id"), F.lit("")) != "")
    )
    # Only the objects of the last frame can rule an event out.
    last_seen = t.visible.join(
        last.select("episode_id", F.col("end.step").alias("step")), STEP, "left_semi"
    ).select(*OBJECT)
    order = [c for c in ("event_ord", "object_id") if c in t.events.columns]
    picked = top_n_facts(hidden.join(last_seen, OBJECT, "left_anti"), n, order).join(
        last, "episode_id", "left"
    )
    landmarks = (
        t.episodes.join(_first_landmarks(t.landmarks), "scene_id")
        if t.landmarks is not None
        else None
    )
    # Three labels other than the answer and the origin are needed, so five are enough.
    phrases = receptacle_phrases(t.events, landmarks, keep=5)
    picked = picked.join(phrases, "episode_id", "left").withColumn(
        "before",
        F.when(F.col("at_timestep").isNotNull(), F.greatest(F.lit(0), F.col("at_timestep") - 1)),
    )
    answer = receptacle_phrase(F.col("to_receptacle"))
    origin = F.when(
        (F.coalesce(F.col("from_receptacle"), F.lit("")) != "")
        & ~F.col("from_receptacle").eqNullSafe(F.col("to_receptacle")),
        F.array(receptacle_phrase(F.col("from_receptacle"))),
    ).otherwise(F.array().cast(NO_TEXTS))
    picked = picked.withColumns({"answer": answer, "origin": origin})
    others = F.filter(
        F.coalesce("phrases", F.array().cast(NO_TEXTS)),
        lambda p: (p != F.col("answer")) & ~F.array_contains("origin", p),
    )
    pool = F.concat(F.array("answer"), F.slice(F.concat("origin", others), 1, 3))
    picked = picked.withColumn("own", pool)
    spare = F.filter(text_array(PLACES), lambda p: ~F.array_contains("own", p))
    return _facts(
        picked,
        "invisible_displacement",
        "ok",
        rank=F.col("rank"),
        query_step=F.col("end.step"),
        encoding_step=F.col("at_timestep"),
        queried_object_id=F.col("object_id"),
        answer_label=F.col("answer"),
        answer_source=F.array(
            F.concat(F.lit("displacement_events[obj_id="), "object_id", F.lit("].to_receptacle")),
            F.concat(F.lit("object_state_track["), "object_id", F.lit("]")),
        ),
        views=_views("before", F.col("end.image_path")),
        options_pool=F.slice(F.concat("own", spare), 1, 4),
        distractor_seeds=text_array(
            ["original_location", "nearby_receptacle", "salient_decoy_location"]
        ),
        displacement_event=F.struct(
            "event_id",
            "at_timestep",
            "object_id",
            "from_receptacle",
            "to_receptacle",
            "hidden_during",
        ),
        object_type=display_name(F.lit(None).cast("string"), F.col("object_id")),
    )


def _first_landmarks(landmarks: DataFrame) -> DataFrame:
    """Per scene the first five distinct landmark phrases by id; more can never be offered."""
    named = (
        landmarks.where(F.coalesce(F.col("landmark_id"), F.lit("")) != "")
        .groupBy("scene_id", receptacle_phrase(F.col("landmark_id")).alias("phrase"))
        .agg(F.min("landmark_id").alias("landmark_id"))
    )
    w = Window.partitionBy("scene_id").orderBy("landmark_id")
    return (
        named.withColumn("__n", F.row_number().over(w))
        .where(F.col("__n") <= 5)
        .select("scene_id", "landmark_id")
    )


@planner
def plan_allocentric(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
    """First object-object edge of each step."""
    relative = ["to the left of it", "to the right of it", "in front of it", "behind it"]
    triplet = F.struct(*[F.col(f"angle_{a}").alias(a) for a in "xyz"])
    edges = (
        # Only what is read below is sorted.
        first_allocentric_edge(
            t.allocentric.select(
                *STEP, "edge_type", "source", "target", "ord_major", "ord_minor", *[f"angle_{a}" for a in "xyz"]
            )
        )
        .select(*STEP, "source", "target", ego_label(triplet).alias("label"))
        .where(F.col("label").isNotNull())
    )
    # A step whose ends are not both in view is no candidate, so it takes no rank.
    for end in ("source", "target"):
        seen = t.visible.select(
            *STEP, F.col("object_id").alias(end), F.col("category").alias(f"{end}_category")
        )
        edges = edges.join(seen, [*STEP, end])
    picked = top_n_facts(edges, n, ["step"])
    source_text = F.concat(
        F.lit("steps["),
        F.col("step").cast("string"),
        F.lit("].edges_allocentric[source="),
        "source",
        F.lit(",target="),
        "target",
        F.lit("].angle_relation"),
    )
    decoys = text_array([relative[0], relative[1], relative[3]])
    return _facts(
        picked,
        "allocentric_encoding",
        "thin",
        rank=F.col("rank"),
        query_step=F.col("step"),
        encoding_step=F.col("step"),
        queried_object_id=F.col("target"),
        reference_object_id=F.col("source"),
        answer_label=F.col("label"),
        answer_source=F.array(source_text),
        views=_views("step"),
        options_pool=F.concat(F.array("label"), decoys),
        distractor_seeds=text_array(["opposite_relation", "viewer_frame_answer"]),
        object_type=display_name(F.col("target_category"), F.col("target")),
        reference_object=display_name(F.col("source_category"), F.col("source")),
    )


def walked_segments(t: EpisodeTables) -> DataFrame:
    """Turns of every segment, or for episodes without any all their steps; unnamed actions never merge."""
    acted = F.coalesce(is_action(F.col("action")), F.lit(False))
    named = F.col("action").isNotNull() & (F.col("action") != "")
    steps = t.steps.select(*STEP, "action", "degrees", acted.cast("int").alias("turn"))
    walked = segment_turns(t.region_changes, steps, totals=["turn"])
    merges = (F.col("turn") == 1) | named
    return walked.where((F.col("turn") == 1) | (F.col("all_turn") == 0)).withColumns(
        {"action": F.when(merges, F.col("action")).otherwise("move"), "merges": merges}
    )


@planner
def plan_route(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
    """Action sequence of a walked segment between two regions."""
    picked = top_n_facts(action_runs(walked_segments(t)), n, ["seg"])
    labels = F.col("turn_labels")
    size = F.size(labels)
    swapped = F.when(
        size >= 2,
        F.concat(
            F.array(F.element_at(labels, -1)),
            F.slice(labels, F.lit(2), F.greatest(size - 2, F.lit(0))),
            F.array(labels[0]),
        ),
    ).otherwise(labels)
    # Every episode without a pick gets a row that says why.
    one, none = F.lit(1), F.lit(0)
    has = (
        t.region_changes.select("episode_id", one.alias("change"), none.alias("act"))
        .unionByName(t.steps.select("episode_id", none.alias("change"), one.alias("act")))
        .groupBy("episode_id")
        .agg(F.sum("change").alias("n_changes"), F.sum("act").alias("n_acts"))
    )
    rows = t.episodes.select("episode_id").join(has, "episode_id", "left").join(picked, "episode_id", "left")
    planned = F.col("rank").isNotNull()
    found = rows.withColumn("answer", F.when(planned, F.array_join(labels, ARROW)))
    own = F.array_distinct(
        F.array(
            F.col("answer"),
            F.array_join(F.reverse(labels), ARROW),
            F.array_join(swapped, ARROW),
            F.lit(ROUTE_DECOY),
        )
    )
    found = found.withColumn("own", own)
    filler = F.transform(
        F.array(*[F.lit(i) for i in range(4)]),
        lambda i: F.when(
            i >= F.size("own"), F.concat(F.lit("decoy_route_"), i.cast("string"))
        ),
    )
    text = lambda c: F.col(c).cast("string")
    too_little = (F.coalesce("n_changes", F.lit(0)) < 2) | (F.coalesce("n_acts", F.lit(0)) == 0)
    return _facts(
        found,
        "route_knowledge",
        F.when(~planned, "unsupported")
        .when(F.col("t1") - F.col("t0") <= 25, "ok")
        .otherwise("thin"),
        rank=F.coalesce("rank", F.lit(1)),
        reason=F.when(
            ~planned,
            F.when(
                too_little, "need_region_segments_and_actions_for_source_goal_route"
            ).otherwise("no_short_source_goal_region_segment"),
        ),
        query_step=F.col("t1"),
        encoding_step=F.col("t0"),
        answer_label=F.col("answer"),
        answer_source=_if(
            planned,
            F.concat(
                F.lit("region_trajectory["),
                text("seg"),
                F.lit(":"),
                (F.col("seg") + 1).cast("string"),
                F.lit("]"),
            ),
            F.concat(
                F.lit("route.turns[step>="), text("t0"), F.lit(" and step<"), text("t1"), F.lit("]")
            ),
        ),
        views=_views("t0", "t1"),
        options_pool=_texts(
            planned, F.slice(F.concat("own", F.filter(filler, lambda f: f.isNotNull())), 1, 4)
        ),
        distractor_seeds=_texts(
            planned, text_array(["reversed_sequence", "swapped_two_turns"])
        ),
        object_type=F.col("goal"),
        source=F.col("source"),
        goal=F.col("goal"),
        turn_labels=labels,
    )


def _decoy_passages(connectivity: DataFrame, labels: DataFrame) -> DataFrame:
    """First three named links per scene, and the first three without passage X for each X of them.

    Leaving out any other passage leaves the first three as they are.
    """
    named = connectivity.where(F.coalesce(F.col("passage_id"), F.lit("")) != "").join(
        labels.withColumnRenamed("region_id", "to_region"), ["scene_id", "to_region"], "left"
    )
    links = named.select(
        "scene_id",
        "row_ord",
        "passage_id",
        F.concat(
            F.lit("use "),
            "passage_id",
            F.lit(" toward "),
            F.coalesce("region_label", "to_region", F.lit("None")),
        ).alias("text"),
    )
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy("row_ord"))
    head = links.withColumn("__n", rank).where(F.col("__n") <= 3)
    skip = head.select("scene_id", F.col("passage_id").alias("skipped")).distinct()
    without = links.join(skip, "scene_id").where(F.col("passage_id") != F.col("skipped"))
    rank = F.row_number().over(Window.partitionBy("scene_id", "skipped").orderBy("row_ord"))
    without = without.withColumn("__n", rank).where(F.col("__n") <= 3)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("__n", "text"))), lambda s: s["text"])
    return (
        head.withColumn("skipped", F.lit(None).cast("string"))
        .select("scene_id", "skipped", "__n", "text")
        .unionByName(without.select("scene_id", "skipped", "__n", "text"))
        .groupBy("scene_id", "skipped")
        .agg(texts.alias("decoys"))
    )


def survey_visits(t: EpisodeTables) -> DataFrame:
    """Regions to plan between, in order: visited ones, or the first four of the layout."""
    seen = visited_regions(t.region_changes)
    enough = seen.groupBy("episode_id").count().where(F.col("count") >= 2).select("episode_id")
    ids = (
        t.regions.where(F.coalesce(F.col("region_id"), F.lit("")) != "")
        .groupBy("scene_id", "region_id")
        .agg(F.min("row_ord").alias("row_ord"))
    )
    w = Window.partitionBy("scene_id").orderBy("row_ord")
    four = ids.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= 4)
    fallback = t.episodes.join(enough, "episode_id", "left_anti").join(four, "scene_id")
    visits = seen.join(enough, "episode_id", "left_semi").join(
        t.episodes.select("episode_id", "scene_id"), "episode_id"
    )
    # A layout region may still have been visited; its view is then known.
    fallback = fallback.join(seen, ["episode_id", "region_id"], "left")
    columns = ["episode_id", "scene_id", "region_id"]
    return visits.select(
        *columns, F.col("first_visit").alias("visit_ord"), "first_visit"
    ).unionByName(
        fallback.select(*columns, F.col("row_ord").alias("visit_ord"), "first_visit")
    )


# Start regions per episode tried in the first round of path searches.
FIRST_STARTS = 4


def _first_pairs(visits: DataFrame, connectivity: DataFrame, n: int) -> DataFrame:
    """First ``n`` connected region pairs per episode, by the order of their visits, with their paths.

    A round searches from the next few start regions of episodes that still lack pairs, so the pairs
    looked at grow with the visits, not with their square.  A start of a scene is searched once,
    however many episodes and rounds share it, and paths are rebuilt for the chosen pairs only.
    """
    numbered = saved(
        with_ordered(
            visits, ["episode_id"], ["visit_ord"], step_block("visit_ord"), {"i": row_number()}
        ),
        "visits",
    )
    goals = numbered.select(
        "episode_id",
        F.col("region_id").alias("goal"),
        F.col("i").alias("j"),
        F.col("first_visit").alias("visit_b"),
    )
    hops = saved(adjacency(connectivity), "hops")
    tree, depth, found, open_, lo, size = None, 0, None, None, 1, FIRST_STARTS
    while True:
        tried = numbered.where(F.col("i").between(lo, lo + size - 1))
        if open_ is not None:
            tried = tried.join(open_, "episode_id", "left_semi")
        tried = tried.select(
            "episode_id",
            "scene_id",
            F.col("region_id").alias("start"),
            "i",
            F.col("first_visit").alias("visit_a"),
        )
        starts = tried.select(*START).distinct()
        if tree is None:
            tree, depth = search_trees(hops, starts)
        else:
            more, deepest = search_trees(hops, starts.join(tree.select(*START), START, "left_anti"))
            tree, depth = tree.unionByName(more), max(depth, deepest)
        reached = tree.where("depth > 0").select(*START, F.col("node").alias("goal"))
        # An episode's regions meet first: the trees reach regions that it has never been to.
        pairs = tried.join(goals, "episode_id").where(F.col("i") < F.col("j")).join(reached, [*START, "goal"])
        if found is not None:
            pairs = pairs.unionByName(found.drop("rank"))
        found = saved(top_n_facts(pairs, n, ["i", "j"]), "pairs")
        lo, size = lo + size, size * 2
        later = numbered.where(F.col("i") >= lo).select("episode_id").distinct()
        full = found.where(F.col("rank") == n).select("episode_id")
        open_ = later.join(full, "episode_id", "left_anti")
        if open_.isEmpty():
            break
    return found.join(rebuilt_paths(tree, depth, found.select(*START, "goal")), [*START, "goal"])


@planner
def plan_survey(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
    """First link of the shortest layout path between two regions of the episode."""
    linked = t.connectivity.select("scene_id").distinct()
    mapped = (
        t.regions.groupBy("scene_id").count().where(F.col("count") >= 2).select("scene_id")
    )
    able = t.episodes.join(linked, "scene_id", "left_semi").join(mapped, "scene_id", "left_semi")
    visits = survey_visits(t).join(able.select("episode_id"), "episode_id", "left_semi")
    labels = last_region_labels(t.regions)
    picked = _first_pairs(visits, t.connectivity, n).withColumns(
        {"hop": F.col("path_regions")[1], "passage": F.col("passages")[0]}
    )
    for col in ("start", "goal", "hop"):
        named = labels.select(
            "scene_id", F.col("region_id").alias(col), F.col("region_label").alias(f"{col}_label")
        )
        picked = picked.join(named, ["scene_id", col], "left").withColumn(
            f"{col}_label", F.coalesce(f"{col}_label", col)
        )
    decoys = _decoy_passages(t.connectivity, labels)
    general = decoys.where(F.col("skipped").isNull()).select(
        "scene_id", F.col("decoys").alias("general")
    )
    special = decoys.where(F.col("skipped").isNotNull()).withColumnRenamed("skipped", "passage")
    picked = picked.join(special, ["scene_id", "passage"], "left").join(general, "scene_id", "left")
    answer = F.concat(F.lit("use "), "passage", F.lit(" toward "), "hop_label")
    picked = picked.withColumns(
        {
            "answer": answer,
            "own": F.coalesce("decoys", "general", F.array().cast(NO_TEXTS)),
        }
    )
    filler = F.filter(
        F.transform(
            F.array(*[F.lit(i) for i in range(3)]),
            lambda i: F.when(
                i >= F.size("own"), F.concat(F.lit("decoy_passage_"), i.cast("string"))
            ),
        ),
        lambda f: f.isNotNull(),
    )
    ends = t.region_changes.groupBy("episode_id").agg(
        F.min("timestep").alias("t_first"), F.max("timestep").alias("t_last")
    )
    known = able.select("episode_id", F.lit(True).alias("__able"))
    rows = (
        t.episodes.select("episode_id")
        .join(known, "episode_id", "left")
        .join(picked.drop("scene_id").join(ends, "episode_id", "left"), "episode_id", "left")
    )
    planned = F.col("rank").isNotNull()
    return _facts(
        rows,
        "survey_knowledge",
        F.when(planned, "thin").otherwise("unsupported"),
        rank=F.coalesce("rank", F.lit(1)),
        reason=F.when(
            ~planned,
            F.when(F.col("__able").isNull(), "weak_or_missing_layout_connectivity").otherwise(
                "no_plannable_source_goal_pair_in_layout"
            ),
        ),
        query_step=F.col("t_last"),
        encoding_step=F.col("t_first"),
        answer_label=F.col("answer"),
        answer_source=_if(
            planned,
            F.lit("world_layout.connectivity"),
            F.concat(
                F.lit("plan_path["),
                "start",
                F.lit("→"),
                "goal",
                F.lit("]="),
                quoted_list(F.col("path_regions")),
            ),
        ),
        views=_views("visit_a", "visit_b"),
        options_pool=_texts(
            planned, limit_options(F.concat(F.array("answer"), "own", filler))
        ),
        distractor_seeds=_texts(planned, text_array(["known_route_answer", "dead_end_path"])),
        object_type=F.col("goal_label"),
        source=F.col("start_label"),
        goal=F.col("goal_label"),
        path_regions=F.col("path_regions"),
        passages=F.col("passages"),
    )


@planner
def plan_perspective(t: EpisodeTables, n: int = 3, params: Params = DEFAULTS) -> DataFrame:
    """No object has a trusted facing, so there is never a fact."""
    rows = t.episodes.where(F.lit(n > 0))
    return _facts(
        rows,
        "perspective_taking",
        "unsupported",
        rank=F.lit(1),
        reason=F.lit("edges_object_frame_empty_no_trusted_facing"),
    )


PLANNERS: dict[str, Callable[..., DataFrame]] = {
    "egocentric_encoding": plan_egocentric,
    "spatial_working_memory": plan_working_memory,
    "invisible_displacement": plan_invisible_displacement,
    "spatial_updating": plan_spatial_updating,
    "allocentric_encoding": plan_allocentric,
    "route_knowledge": plan_route,
    "survey_knowledge": plan_survey,
    "perspective_taking": plan_perspective,
}


def plan_all(
    t: EpisodeTables,
    constructs: Iterable[str] = CONSTRUCT_NAMES,
    n: int = 3,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Facts of the chosen constructs, numbered per episode in construct order."""
    names = [c for c in constructs if c in PLANNERS]
    parts = [
        PLANNERS[c].views(t, n, params).withColumn("construct_ord", F.lit(i))
        for i, c in enumerate(names)
    ]
    facts = with_images(union_facts(*parts), t.steps)
    # At most n rows per construct and episode reach this window.
    w = Window.partitionBy("episode_id").orderBy("construct_ord", "rank")
    return facts.withColumn("fact_no", F.row_number().over(w) - 1)
