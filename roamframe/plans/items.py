"""Facts worded as four-option items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamframe.functions import geometry as G
from roamframe.functions.clean import CONSTRUCTS, STYLES
from roamframe.functions.options import distractor_rationale, options_map, options_rotate
from roamframe.functions.text import (
    base_id,
    construct_hint,
    core_question,
    display_name,
    ego_label,
    frame_cue,
    item_id,
    planned_name,
    region_label,
    scrub_leak,
)
from roamframe.operators.memory import non_visible_objects, remember
from roamframe.operators.poses import STEP, point
from roamframe.params import DEFAULTS, Params
from roamframe.plans.tables import EpisodeTables
from roamframe.storage import saved

MENTIONED = 4
# What is read of a step that a question describes.
CONTEXT = (*STEP, "cam_x", "cam_y", "cam_z", "pitch_deg", "yaw_deg", "region_id", "region_type")
EMPTY_PREAMBLE = "You observe several objects in the environment."


def _fixed(construct: Column, place: int) -> Column:
    out = None
    for row in CONSTRUCTS:
        value = F.lit(row[place])
        out = F.when(construct == row[0], value) if out is None else out.when(
            construct == row[0], value
        )
    return out


def answerable(facts: DataFrame) -> Column:
    return (F.col("status") != "unsupported") & (F.coalesce("answer_label", F.lit("")) != "")


def limit_nonvisible(memory: DataFrame, n: int = MENTIONED) -> DataFrame:
    """First ``n`` remembered objects out of view per step, in order of first sighting."""
    w = Window.partitionBy(*STEP).orderBy("first_step", "first_det_ord")
    return (
        non_visible_objects(memory)
        .withColumn("__n", F.row_number().over(w))
        .where(F.col("__n") <= n)
    )


def question_context(facts: DataFrame, t: EpisodeTables, params: Params = DEFAULTS) -> DataFrame:
    """Facts with what is seen and remembered at the step their question describes."""
    facts = facts.withColumn("__at", F.coalesce("encoding_step", "query_step"))
    # Facts are wide and ask for few steps, so the steps are found and described first, and the facts move once.
    wanted = facts.select("episode_id", "__at").distinct()
    logged = t.steps.select("episode_id", F.col("step").alias("__at"), F.col("step").alias("__hit"))
    start = t.steps.groupBy("episode_id").agg(F.min("step").alias("__start"))
    at = saved(
        wanted.join(logged, ["episode_id", "__at"], "left")
        .join(start, "episode_id", "left")
        .select("episode_id", "__at", F.coalesce("__hit", "__start").alias("context_step")),
        "context_steps",
    )
    steps = saved(
        t.steps.join(
            at.select("episode_id", F.col("context_step").alias("step")).distinct(), STEP, "left_semi"
        ).select(*[c for c in CONTEXT if c in t.steps.columns]),
        "described",
    )
    relation = G.direction_triplet(point("local"), params)
    seen = saved(
        t.visible.join(steps.select(*STEP), STEP, "left_semi")
        .withColumn("__r", relation)
        .select(
            *STEP,
            F.struct(
                "det_ord",
                "object_id",
                display_name(F.col("category"), F.col("object_id")).alias("name"),
                ego_label(F.col("__r")).alias("label"),
                F.when(F.col("__r.x") != "", F.concat(F.lit("to your "), "__r.x"))
                .when(F.col("__r.z") == "front", "ahead of you")
                .when(F.col("__r.z") != "", F.concat("__r.z", F.lit(" you")))
                .alias("relation"),
            ).alias("o"),
        )
        # A step is one camera frame with each object once, so the list is one frame long.
        .groupBy(*STEP)
        .agg(F.sort_array(F.collect_list("o")).alias("seen")),
        "seen",
    )
    # What is remembered at a step are the objects first seen until then, in that order.  The first few
    # out of view are among the first few and as many more as a frame shows, so only these are expanded.
    most = seen.groupBy("episode_id").agg(F.max(F.size("seen")).alias("__shown"))
    order = Window.partitionBy("episode_id").orderBy("__first", "object_id")
    early = (
        t.spans.groupBy("episode_id", "object_id")
        .agg(F.min(F.struct("first_step", "first_det_ord")).alias("__first"))
        .withColumn("__n", F.row_number().over(order))
        .join(most, "episode_id", "left")
        .where(F.col("__n") <= MENTIONED + F.coalesce("__shown", F.lit(0)))
        .select("episode_id", "object_id")
    )
    spans = t.spans.join(early, ["episode_id", "object_id"], "left_semi")
    gone = (
        limit_nonvisible(remember(spans, steps))
        .select(
            *STEP,
            F.struct(
                "__n", "object_id", display_name(F.col("category"), F.col("object_id")).alias("name")
            ).alias("o"),
        )
        .groupBy(*STEP)
        .agg(F.sort_array(F.collect_list("o")).alias("gone"))
    )
    rooms = steps.select(*STEP, "region_id", "region_type")
    context = rooms.join(seen, STEP, "left").join(gone, STEP, "left")
    # An episode's facts are few, so what they ask for is one short list.
    found = at.join(context.withColumnRenamed("step", "context_step"), ["episode_id", "context_step"], "left")
    values = [c for c in found.columns if c not in ("episode_id", "context_step", "__at")]
    listed = found.groupBy("episode_id").agg(
        F.collect_list(F.struct("__at", "context_step", *values)).alias("__found")
    )
    own = F.filter("__found", lambda f: f["__at"].eqNullSafe(F.col("__at")))
    # A step that is logged twice counts twice.
    return (
        facts.join(listed, "episode_id", "left")
        .withColumn("__own", F.explode_outer(own))
        .select("episode_id", "__own.context_step", *[c for c in facts.columns if c not in ("episode_id", "__at")],
                *[F.col(f"__own.{c}") for c in values])
    )


def verbose_preamble(params: Params = DEFAULTS) -> Column:
    """Scene description over the columns of :func:`question_context`; never tells the answer."""
    n = F.size("image_paths")
    queried = F.when(F.col("queried_object_id") != "", F.col("queried_object_id"))
    answer = F.lower(F.coalesce("answer_label", F.lit("")))
    cue = F.when(n > 1, F.trim(frame_cue(n)))
    hint = F.when(n > 1, construct_hint(F.col("construct"), F.col("source"), F.col("goal")))
    known_room = F.when(
        (F.coalesce("region_type", F.lit("")) != "") | (F.coalesce("region_id", F.lit("")) != ""),
        region_label(F.col("region_type"), F.col("region_id")),
    )
    room = F.concat(F.lit("You are looking around a space identified as "), known_room, F.lit("."))
    nothing = F.lit(False)
    others = F.filter(
        "seen", lambda o: ~F.coalesce(o["object_id"] == queried, nothing)
    )
    # A relation that would spell the answer is left out.
    phrases = F.transform(
        others,
        lambda o: F.when(
            o["relation"].isNull() | F.coalesce(F.lower(o["label"]) == answer, nothing),
            F.concat(F.lit("a "), o["name"]),
        ).otherwise(F.concat(F.lit("a "), o["name"], F.lit(" ("), o["relation"], F.lit(")"))),
    )
    count = F.size(phrases)
    around = F.when(
        count == 1, F.concat(F.lit("Also visible is "), phrases[0], F.lit("."))
    ).when(
        count > 1,
        F.concat(
            F.lit("Among other things, you can see "),
            F.array_join(F.slice(phrases, F.lit(1), count - 1), ", "),
            F.lit(", and "),
            F.element_at(phrases, -1),
            F.lit("."),
        ),
    )
    name = planned_name(F.col("object_type"), queried)
    in_view = F.coalesce(F.exists("seen", lambda o: o["object_id"] == queried), nothing)
    asked = F.when(
        queried.isNotNull(),
        F.when(in_view, F.concat(F.lit("There is also a "), name, F.lit(" in the scene."))).otherwise(
            F.concat(F.lit("You previously noticed a "), name, F.lit("."))
        ),
    )
    lost = F.transform(
        F.filter("gone", lambda o: ~F.coalesce(o["object_id"] == queried, nothing)),
        lambda o: o["name"],
    )
    no_longer = F.when(
        F.size(lost) > 0,
        F.concat(
            F.lit("Some objects are no longer in view, including "),
            F.array_join(lost, ", "),
            F.lit("."),
        ),
    )
    text = F.trim(F.concat_ws(" ", cue, hint, room, around, asked, no_longer))
    text = scrub_leak(text, F.col("answer_label"))
    return F.when(text != "", text).otherwise(EMPTY_PREAMBLE)


def question_text(params: Params = DEFAULTS) -> Column:
    """Short question over fact columns."""
    return core_question(
        F.col("construct"),
        planned_name(F.col("object_type"), F.col("queried_object_id")),
        planned_name(F.col("reference_object"), F.col("reference_object_id")),
        F.col("source"),
        F.col("goal"),
        F.size("image_paths"),
    )


def pair_items(items: DataFrame) -> DataFrame:
    """Link the two styles of a fact; null unless there are exactly two."""
    w = Window.partitionBy("episode_id", "fact_no")
    other = F.max(F.col("item_id")).over(w)
    same = F.min(F.col("item_id")).over(w)
    return items.withColumn(
        "paired_item_id",
        F.when(
            F.count(F.lit(1)).over(w) == 2, F.when(F.col("item_id") == other, same).otherwise(other)
        ),
    )


def draft_items(
    facts: DataFrame,
    t: EpisodeTables,
    styles: Sequence[str] = STYLES,
    tag: str | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """One item per fact and style; unsupported or answerless facts give one blank item."""
    styles = list(styles)
    where = t.episodes.select("episode_id", "scene_id", "environment")
    facts = facts.join(where, "episode_id").withColumns(
        {
            "tag": F.col("scene_id") if tag is None else F.lit(tag),
            "class": _fixed(F.col("construct"), 1),
            "frame_of_reference": _fixed(F.col("construct"), 2),
        }
    )
    choice = options_rotate(
        F.col("answer_label"), F.col("options_pool"), F.col("distractor_seeds")
    )
    ready = facts.where(answerable(facts)).withColumns(
        {"__choice": choice, "__core": question_text(params)}
    )
    if "verbose" in styles:
        ready = question_context(ready, t, params)
    ready = ready.withColumn("options", options_map(F.col("__choice.ordered")))
    ids = [
        item_id(
            F.col("tag"),
            F.col("fact_no"),
            F.col("construct"),
            F.col("query_step"),
            F.col("queried_object_id"),
            F.lit(s),
        )
        for s in styles
    ]
    variants = [
        F.struct(
            F.lit(s).alias("question_style"),
            ids[i].alias("item_id"),
            (ids[1 - i] if len(styles) == 2 else F.lit(None).cast("string")).alias("paired_item_id"),
            (
                F.concat_ws(" ", verbose_preamble(params), F.col("__core"))
                if s == "verbose"
                else F.col("__core")
            ).alias("question"),
        )
        for i, s in enumerate(styles)
    ]
    common = ["episode_id", "fact_no", "construct", "class", "frame_of_reference"]
    place = ["environment", "scene_id"]
    worded = ready.withColumn("__v", F.explode(F.array(*variants))).select(
        *common,
        F.col("__v.item_id").alias("item_id"),
        *place,
        "image_paths",
        F.col("__v.question").alias("question"),
        "options",
        F.col("__choice.key").alias("answer"),
        "answer_source",
        "queried_object_id",
        distractor_rationale(F.col("options"), F.col("answer_label")).alias("distractor_rationale"),
        "status",
        "query_step",
        "encoding_step",
        F.col("__v.question_style").alias("question_style"),
        F.col("__v.paired_item_id").alias("paired_item_id"),
        "displacement_event",
    )
    blank = F.col("status") != "unsupported"
    reason = F.coalesce(
        F.when(F.col("reason") != "", F.col("reason")),
        F.when(blank, "no_answer_label").otherwise("unsupported"),
    )
    empty = F.create_map().cast("map<string,string>")
    unworded = facts.where(~answerable(facts)).select(
        *common,
        F.concat_ws(
            "_",
            base_id(F.col("tag"), F.col("fact_no")),
            "construct",
            F.when(blank, "blank").otherwise("unsupported"),
        ).alias("item_id"),
        *place,
        F.array().cast("array<string>").alias("image_paths"),
        F.lit("").alias("question"),
        empty.alias("options"),
        F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("array<string>").alias("answer_source"),
        F.lit(None).cast("string").alias("queried_object_id"),
        F.create_map(F.lit("reason"), reason).alias("distractor_rationale"),
        F.lit("unsupported").alias("status"),
        F.lit(None).cast("int").alias("query_step"),
        F.lit(None).cast("int").alias("encoding_step"),
        F.lit("concise").alias("question_style"),
        F.lit(None).cast("string").alias("paired_item_id"),
        F.lit(None).cast(facts.schema["displacement_event"].dataType).alias("displacement_event"),
    )
    # Filled in later by people or by evaluation runs.
    later = {
        "difficulty": "int",
        "agent_trajectory": "array<struct<step:int>>",
        "agent_actions": "array<string>",
        "blind_llm_correct": "boolean",
        "caption_llm_correct": "boolean",
        "vision_necessary": "boolean",
    }
    return worded.unionByName(unworded).withColumns(
        {name: F.lit(None).cast(type_) for name, type_ in later.items()}
    )
