"""Memory of what was seen and where.

Per object the sightings and the pose updates of displaced objects cut the episode into spans on
which the remembered row is constant.  Spans are what is shuffled; the rows per step come out of a
join of spans with steps on (episode, block of steps), so the large step x object result is
produced in place and never moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamframe.operators.poses import STEP
from roamframe.ordered import (
    BLOCK_COLUMN,
    first_value,
    following,
    last_value,
    row_number,
    step_block,
    with_ordered,
)

OBJECT = ["episode_id", "object_id"]
SPAN_BLOCK = 64


def memory_spans(steps: DataFrame, visible: DataFrame, states: DataFrame) -> DataFrame:
    """Spans [from_step, next_step) of constant memory per object, from its first sighting on.

    ``from_pos`` and ``next_pos`` are the same bounds as places in the episode; ``seen_`` is where
    the object was in the camera frame when last seen.
    """
    what = F.struct(*[f"pos_{a}" for a in "xyz"], "in_camera_fov", "parent_receptacle")
    sightings = visible.select(
        *OBJECT,
        "step",
        "pos",
        what.alias("what"),
        F.struct("step", "category", *[f"local_{a}" for a in "xyz"]).alias("sight"),
        F.struct("step", "det_ord").alias("opened"),
    )
    updates = states.join(steps.select(*STEP, "pos"), STEP).select(
        *OBJECT,
        "step",
        "pos",
        what.alias("what"),
        *[F.lit(None).cast(sightings.schema[c].dataType).alias(c) for c in ("sight", "opened")],
    )
    # A sighting already shows the state of its step; what counts are updates while unseen.  Both kinds
    # of rows meet where the spans are made, so that nothing is dealt out twice.
    def unseen(marks: DataFrame) -> DataFrame:
        here = Window.partitionBy(*OBJECT, BLOCK_COLUMN, "step")
        marks = marks.withColumn("__seen", F.max(F.col("sight").isNotNull()).over(here))
        return marks.where(F.col("sight").isNotNull() | ~F.col("__seen")).drop("__seen")

    spans = with_ordered(
        sightings.unionByName(updates),
        OBJECT,
        ["step"],
        step_block("step"),
        {
            "sight": last_value("sight"),
            "opened": first_value("opened"),
            "next_step": following("step"),
            "next_pos": following("pos"),
        },
        once=True,
        dealt=unseen,
    )
    return spans.where(F.col("sight").isNotNull()).select(
        *OBJECT,
        F.col("sight.category").alias("category"),
        F.col("sight.step").alias("last_seen"),
        F.col("opened.step").alias("first_step"),
        F.col("opened.det_ord").alias("first_det_ord"),
        F.col("step").alias("from_step"),
        "next_step",
        F.col("pos").alias("from_pos"),
        "next_pos",
        *[F.col(f"sight.local_{a}").alias(f"seen_{a}") for a in "xyz"],
        "what.*",
    )


def remember(spans: DataFrame, steps: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Memory rows at the given steps, with the camera pose of the step.

    ``wanted`` (episode_id, step, object_id) names the rows that are asked for; then a span meets
    only the steps that ask for its object, and the grid of steps and objects is never built.
    """
    last = steps.groupBy("episode_id").agg(F.max("step").alias("__end"))
    pieces = (
        spans.join(last, "episode_id")
        .withColumn("__to", F.least(F.coalesce(F.col("next_step") - 1, F.col("__end")), "__end"))
        .where(F.col("__to") >= F.col("from_step"))
        .withColumn(
            "__blk",
            F.explode(
                F.sequence(
                    step_block("from_step", SPAN_BLOCK),
                    step_block("__to", SPAN_BLOCK),
                    F.lit(1).cast("bigint"),
                )
            ),
        )
        .drop("__end", "next_step", "from_pos", "next_pos", "seen_x", "seen_y", "seen_z")
    )
    here = steps.select(
        *STEP,
        *[c for c in ("cam_x", "cam_y", "cam_z", "pitch_deg", "yaw_deg") if c in steps.columns],
        step_block("step", SPAN_BLOCK).alias("__blk"),
    )
    keys = ["episode_id", "__blk"]
    if wanted is not None:
        here = here.join(wanted.select(*STEP, "object_id").distinct(), STEP)
        keys = ["episode_id", "object_id", "__blk"]
    return (
        here.join(pieces, keys)
        .where(F.col("step").between(F.col("from_step"), F.col("__to")))
        .drop("__blk", "__to", "from_step")
    )


def object_memory(steps: DataFrame, visible: DataFrame, states: DataFrame) -> DataFrame:
    """Every object at every step from its first sighting on: last seen step, remembered pose."""
    return remember(memory_spans(steps, visible, states), steps)


def non_visible_objects(memory: DataFrame) -> DataFrame:
    """Memory minus what is in view: an object in view was last seen at this very step."""
    return memory.where(F.col("last_seen") < F.col("step"))


def memory_minus_visible(memory: DataFrame, visible: DataFrame) -> DataFrame:
    """The same set difference by key, for memory rows that were not built here."""
    return memory.join(visible.select(*STEP, "object_id"), [*STEP, "object_id"], "left_anti")


def remembered_position(memory: DataFrame, states: DataFrame) -> DataFrame:
    """Exact state row of the step if there is one, else the memory position."""
    now = states.select(*STEP, "object_id", F.struct(*[f"pos_{a}" for a in "xyz"]).alias("__now"))
    rest = [c for c in memory.columns if not c.startswith("pos_")]
    return memory.join(now, [*STEP, "object_id"], "left").select(
        *rest,
        *[
            F.when(F.col("__now").isNotNull(), F.col("__now")[f"pos_{a}"])
            .otherwise(F.col(f"pos_{a}"))
            .alias(f"pos_{a}")
            for a in "xyz"
        ],
    )


def memory_order(visible: DataFrame) -> DataFrame:
    """Objects of an episode numbered by first sighting."""
    first = (
        visible.groupBy(*OBJECT)
        .agg(F.min(F.struct("step", "det_ord")).alias("f"))
        .select(*OBJECT, F.col("f.step").alias("first_step"), F.col("f.det_ord").alias("first_det_ord"))
    )
    return with_ordered(
        first,
        ["episode_id"],
        ["first_step", "first_det_ord"],
        step_block("first_step"),
        {"mem_ord": row_number()},
    ).withColumn("mem_ord", F.col("mem_ord") - 1)


def union_objects(visible: DataFrame, non_visible: DataFrame) -> DataFrame:
    """Visible and remembered objects of every step, tagged."""
    seen = visible.withColumn("visibility", F.lit("visible"))
    gone = (
        non_visible.withColumn("visibility", F.lit("non_visible"))
        .withColumnRenamed("last_seen", "last_seen_step")
    )
    cols = [
        *STEP, "object_id", "visibility", "category", "pos_x", "pos_y", "pos_z",
        "local_x", "local_y", "local_z", "last_seen_step", "in_camera_fov", "parent_receptacle",
        "px_u", "px_v", "alpha", "beta", "cmin", "rmin", "cmax", "rmax", "det_ord",
        "first_step", "first_det_ord",
    ]
    both = seen.unionByName(gone, allowMissingColumns=True)
    return both.select(*[c for c in cols if c in both.columns])
