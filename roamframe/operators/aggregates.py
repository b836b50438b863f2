"""Groupings over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamframe.functions.text import receptacle_phrase
from roamframe.ordered import BLOCK, step_block


def displaced_ids(events: DataFrame) -> DataFrame:
    return events.where(F.coalesce(F.col("object_id"), F.lit("")) != "").select(
        "episode_id", "object_id"
    ).distinct()


def receptacle_pool(events: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
    """Distinct receptacles of an episode: ends of its events and landmarks of its layout."""
    pool = events.select(
        "episode_id", F.explode(F.array("from_receptacle", "to_receptacle")).alias("receptacle_id")
    )
    if landmarks is not None:
        pool = pool.unionByName(
            landmarks.select("episode_id", F.col("landmark_id").alias("receptacle_id"))
        )
    return pool.where(F.coalesce(F.col("receptacle_id"), F.lit("")) != "").distinct()


def receptacle_phrases(events: DataFrame, landmarks: DataFrame | None, keep: int) -> DataFrame:
    """First ``keep`` distinct receptacle phrases per episode, by receptacle id."""
    phrases = (
        receptacle_pool(events, landmarks)
        .groupBy("episode_id", receptacle_phrase(F.col("receptacle_id")).alias("phrase"))
        .agg(F.min("receptacle_id").alias("receptacle_id"))
    )
    order = Window.partitionBy("episode_id").orderBy("receptacle_id")
    return (
        phrases.withColumn("__n", F.row_number().over(order))
        .where(F.col("__n") <= keep)
        .groupBy("episode_id")
        .agg(F.sort_array(F.collect_list(F.struct("__n", "phrase"))).alias("p"))
        .select("episode_id", F.col("p.phrase").alias("phrases"))
    )


def visited_regions(trajectory: DataFrame) -> DataFrame:
    """Distinct regions by first visit."""
    return (
        trajectory.where(F.coalesce(F.col("region_id"), F.lit("")) != "")
        .groupBy("episode_id", "region_id")
        .agg(F.min("timestep").alias("first_visit"))
    )


def region_labels(regions: DataFrame) -> DataFrame:
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("region_id"))
    return regions.where(F.coalesce(F.col("region_id"), F.lit("")) != "").select(
        "scene_id", "region_id", label.alias("region_label")
    )


def last_region_labels(regions: DataFrame) -> DataFrame:
    """One label per region: that of its last row."""
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("region_id"))
    return (
        regions.where(F.coalesce(F.col("region_id"), F.lit("")) != "")
        .groupBy("scene_id", "region_id")
        .agg(F.max_by(label, "row_ord").alias("region_label"))
    )


def _in_parts(df: DataFrame, row, name: str, order: str) -> DataFrame:
    """Ordered array per episode, in parts of at most BLOCK steps so that no array is unbounded."""
    return (
        df.withColumn("part", step_block(order).cast("int"))
        .groupBy("episode_id", "part")
        .agg(F.sort_array(F.collect_list(row)).alias(name))
    )


def agent_trajectory(steps: DataFrame) -> DataFrame:
    """Pose and image per step as an array; part ``n`` holds steps from ``n * BLOCK`` on."""
    row = F.struct(
        "step",
        F.array("cam_x", "cam_y", "cam_z").alias("position"),
        F.array("pitch_deg", "yaw_deg", "roll_deg").alias("rotation"),
        "image_path",
    )
    return _in_parts(steps, row, "agent_trajectory", "step")


def agent_actions(steps: DataFrame) -> DataFrame:
    return _in_parts(steps, F.struct("step", "action", "degrees"), "agent_actions", "step")


def assemble_route(landmarks: DataFrame, turns: DataFrame) -> DataFrame:
    """Landmark and turn arrays per episode, in parts of steps."""
    a = _in_parts(
        landmarks, F.struct("ord", "step", "object_id", "category", "distance_label"), "landmarks", "step"
    )
    b = _in_parts(turns, F.struct("ord", "step", "action", "degrees"), "turns", "step")
    return a.join(b, ["episode_id", "part"], "full")


def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_steps"))


def item_status_counts(items: DataFrame) -> DataFrame:
    """Items per status, and their total."""
    return items.rollup("status").agg(F.count(F.lit(1)).alias("n_items")).select(
        F.coalesce("status", F.lit("total")).alias("status"), "n_items"
    )


__all__ = [
    "BLOCK",
    "agent_actions",
    "agent_trajectory",
    "assemble_route",
    "displaced_ids",
    "item_status_counts",
    "receptacle_phrases",
    "receptacle_pool",
    "region_labels",
    "step_counts",
    "visited_regions",
]
