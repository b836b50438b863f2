"""Landmarks, turns, region segments and action runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamframe.functions import geometry as G
from roamframe.functions.clean import filter_actions, is_movement
from roamframe.functions.text import action_label, region_label
from roamframe.operators.poses import STEP, point
from roamframe.ordered import (
    following,
    last_value,
    next_value,
    row_number,
    running_sum,
    step_block,
    total,
    with_ordered,
)
from roamframe.params import DEFAULTS, Params

# Segments longer than this many steps are planned only with few turns.
LONG_SEGMENT, MANY_TURNS = 40, 20
MAX_TOKENS = 8


def assign_ord(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """0-based ordinal per episode; the first order column is a step."""
    return with_ordered(
        df, ["episode_id"], order, step_block(order[0]), {name: row_number()}
    ).withColumn(name, F.col(name) - 1)


def route_landmarks(
    visible: DataFrame, params: Params = DEFAULTS, include_within_reach: bool = False
) -> DataFrame:
    """First step at which each object is nearby, in (step, detection) order."""
    p = point("local")
    label = G.distance_label(G.norm(p["x"], p["y"], p["z"]), params)
    wanted = ["nearby", "within reach"] if include_within_reach else ["nearby"]
    first = (
        visible.withColumn("distance_label", label)
        .where(F.col("distance_label").isin(wanted))
        .groupBy("episode_id", "object_id")
        .agg(
            F.min_by(
                F.struct("step", "det_ord", "category", "distance_label"),
                F.struct("step", "det_ord"),
            ).alias("f")
        )
        .select("episode_id", "object_id", "f.*")
    )
    return assign_ord(first, ["step", "det_ord"]).select(
        "episode_id", "step", "object_id", "category", "distance_label", "ord"
    )


def route_turns(steps: DataFrame) -> DataFrame:
    """Executed actions in order."""
    turns = filter_actions(steps).select("episode_id", "step", "action", "degrees")
    return assign_ord(turns, ["step"])


def step_lookup(steps: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(steps, STEP)


def moved_between(steps: DataFrame, spans: DataFrame) -> DataFrame:
    """Whether a movement happened at a step in (from_step, to_step].

    Running movement counts at the two ends replace the scan over the range.
    """
    moves = with_ordered(
        steps.select(*STEP, is_movement(F.col("action")).cast("int").alias("m")),
        ["episode_id"],
        ["step"],
        step_block("step"),
        {"moves": running_sum("m")},
    ).select(*STEP, "moves")
    out = spans
    for end in ("from", "to"):
        at = moves.select(
            "episode_id", F.col("step").alias(f"{end}_step"), F.col("moves").alias(f"__{end}")
        )
        out = out.join(at, ["episode_id", f"{end}_step"])
    return out.withColumn("moved", F.col("__to") > F.col("__from")).drop("__from", "__to")


def next_movement(steps: DataFrame) -> DataFrame:
    """Position of the first movement strictly after each step."""
    marked = steps.withColumn("__m", F.when(is_movement(F.col("action")), F.col("pos")))
    return with_ordered(
        marked, ["episode_id"], ["step"], step_block("step"), {"next_move": next_value("__m")}
    ).drop("__m")


def exclude_displaced(df: DataFrame, displaced: DataFrame) -> DataFrame:
    return df.join(displaced, ["episode_id", "object_id"], "left_anti")


def numbered_trajectory(change_points: DataFrame) -> DataFrame:
    """Change points with their 0-based place and the next one."""
    nxt = change_points.withColumn("__self", F.struct("timestep", "region_id", "region_type"))
    return with_ordered(
        nxt,
        ["episode_id"],
        ["timestep"],
        step_block("timestep"),
        {"seg": row_number(), "__next": following("__self")},
    ).select(
        "episode_id",
        (F.col("seg") - 1).alias("seg"),
        F.col("timestep").alias("t0"),
        F.col("__next.timestep").alias("t1"),
        F.col("region_id").alias("source_region_id"),
        F.col("__next.region_id").alias("goal_region_id"),
        region_label(F.col("region_type"), F.col("region_id")).alias("source"),
        region_label(F.col("__next.region_type"), F.col("__next.region_id")).alias("goal"),
    )


def region_segments(change_points: DataFrame) -> DataFrame:
    """Consecutive change points with different regions."""
    return numbered_trajectory(change_points).where(
        F.col("t1").isNotNull()
        & (F.col("t1") > F.col("t0"))
        & ~F.col("source_region_id").eqNullSafe(F.col("goal_region_id"))
    )


def segment_turns(
    change_points: DataFrame, turns: DataFrame, totals: Sequence[str] = ()
) -> DataFrame:
    """Turns with ``t0 <= step < t1`` and the segment between two change points they lie in.

    Change points and turns are merged and scanned in order once: the latest change before a turn, the
    next one after it, and how many came before.  A segment's regions differ.  ``totals`` names number
    columns of ``turns`` whose sums over the episode are wanted as ``all_`` columns.
    """
    change = ["timestep", "region_id", "region_type"]
    points = change_points.select(
        "episode_id",
        F.col("timestep").alias("__t"),
        F.lit(0).alias("__q"),
        F.struct(*change).alias("__c"),
        *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in totals],
    )
    asked = turns.select(
        "episode_id",
        F.col("step").alias("__t"),
        F.lit(1).alias("__q"),
        *totals,
        F.struct(*[c for c in turns.columns if c not in ("episode_id", "step", *totals)]).alias("__row"),
    )
    merged = points.unionByName(asked, allowMissingColumns=True).withColumn("__one", 1 - F.col("__q"))
    scanned = with_ordered(
        merged,
        ["episode_id"],
        ["__t", "__q"],
        step_block("__t"),
        {"__n": running_sum("__one"), "__at": last_value("__c"), "__next": next_value("__c")}
        | {f"all_{c}": total(c) for c in totals},
        once=True,
    )
    found = scanned.where(
        (F.col("__q") == 1)
        & (F.col("__next.timestep") > F.col("__at.timestep"))
        & ~F.col("__at.region_id").eqNullSafe(F.col("__next.region_id"))
    )
    return found.select(
        "episode_id",
        F.col("__t").alias("step"),
        "__row.*",
        *totals,
        *[f"all_{c}" for c in totals],
        (F.col("__n") - 1).cast("int").alias("seg"),
        F.col("__at.timestep").alias("t0"),
        F.col("__next.timestep").alias("t1"),
        F.col("__at.region_id").alias("source_region_id"),
        F.col("__next.region_id").alias("goal_region_id"),
        region_label(F.col("__at.region_type"), F.col("__at.region_id")).alias("source"),
        region_label(F.col("__next.region_type"), F.col("__next.region_id")).alias("goal"),
    )


def run_lengths(turns: Column) -> Column:
    """Array of (step, action, degrees, merges) folded into runs of equal action and angle."""

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (
            (F.size(acc) > 0)
            & t["merges"]
            & (last["action"] == t["action"])
            & last["degrees"].eqNullSafe(t["degrees"])
        )
        longer = F.struct(
            last["action"].alias("action"),
            last["degrees"].alias("degrees"),
            (last["n"] + 1).alias("n"),
        )
        fresh = F.struct(
            t["action"].alias("action"), t["degrees"].alias("degrees"), F.lit(1).alias("n")
        )
        return F.when(
            F.coalesce(same, F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer)),
        ).otherwise(F.concat(acc, F.array(fresh)))

    nothing = F.array().cast("array<struct<action:string,degrees:double,n:int>>")
    return F.aggregate(turns, nothing, step)


def action_runs(segment_turns: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Run-length text of each plannable segment's turns; long lists end in an ellipsis.

    A segment is skipped if it is long and has many turns.  Of a long segment, one turn more than a
    plannable one can have tells that it is to be skipped; of the others all turns are gathered.
    """
    bounds = ["t0", "t1", "source", "goal", "source_region_id", "goal_region_id"]
    merges = F.col("merges") if "merges" in segment_turns.columns else F.lit(True)
    place = Window.partitionBy("episode_id", "seg").orderBy("step")
    turn = F.struct(
        "step", "action", F.col("degrees").cast("double").alias("degrees"), merges.alias("merges")
    )
    gathered = (
        segment_turns.withColumn("__n", F.row_number().over(place))
        .where((F.col("t1") - F.col("t0") <= LONG_SEGMENT) | (F.col("__n") <= MANY_TURNS + 1))
        .groupBy("episode_id", "seg", *bounds)
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .where((F.col("t1") - F.col("t0") <= LONG_SEGMENT) | (F.size("turns") <= MANY_TURNS))
    )
    labels = F.transform(
        run_lengths(F.col("turns")), lambda r: action_label(r["action"], r["degrees"], r["n"])
    )
    cut_short = F.concat(F.slice("labels", 1, max_tokens - 1), F.array(F.lit("…")))
    return gathered.withColumn("labels", labels).select(
        "episode_id",
        "seg",
        *bounds,
        F.when(F.size("labels") > max_tokens, cut_short).otherwise(F.col("labels")).alias(
            "turn_labels"
        ),
    )
