"""From detections to objects placed in the camera frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.functions import geometry as G
from roamframe.functions.clean import valid_bbox_detect, valid_bbox_marker
from roamframe.params import DEFAULTS, Params

STEP = ["episode_id", "step"]
BOX = ["cmin", "rmin", "cmax", "rmax"]


def dedup_last(df: DataFrame, keys: Sequence[str], ord_col: str) -> DataFrame:
    """Last row wins by key."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(ord_col)).alias("__row"))
        .select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    )


def point(prefix: str) -> Column:
    return G.xyz(*[F.col(f"{prefix}_{a}") for a in "xyz"])


def catalog_keys(objects: DataFrame) -> list[str]:
    """Catalogs are per episode where they say so, else shared."""
    return [k for k in ("episode_id", "object_id") if k in objects.columns]


def resolve_pose(detections: DataFrame, states: DataFrame, objects: DataFrame) -> DataFrame:
    """Pose and category per detection: state at exactly that step, else catalog, else dropped.

    ``states`` holds displaced objects only; it and ``objects`` have one row per key.
    """
    state = states.select(*STEP, "object_id", _state().alias("__state"))
    posed = detections.join(state, [*STEP, "object_id"], "left")
    return _posed(posed, objects, detections.columns)


def _state() -> Column:
    return F.struct(
        "category",
        *[f"pos_{a}" for a in "xyz"],
        *[f"rot_{a}" for a in "xyz"],
        "in_camera_fov",
        "parent_receptacle",
    )


def _posed(rows: DataFrame, objects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pose of rows that carry their state, or null, as ``__state``."""
    keys = catalog_keys(objects)
    catalog = objects.select(
        *keys,
        F.struct("category", *[f"pos_{a}" for a in "xyz"], *[f"rot_{a}" for a in "xyz"]).alias(
            "__catalog"
        ),
    )
    has_state = F.col("__state").isNotNull()
    pose = [
        F.when(has_state, F.col("__state")[c]).otherwise(F.col("__catalog")[c]).alias(c)
        for c in ["category", *[f"pos_{a}" for a in "xyz"], *[f"rot_{a}" for a in "xyz"]]
    ]
    return (
        rows.join(catalog, keys, "left")
        .where(has_state | F.col("__catalog").isNotNull())
        .select(
            *columns,
            *pose,
            has_state.alias("from_state"),
            F.col("__state.in_camera_fov").alias("in_camera_fov"),
            F.col("__state.parent_receptacle").alias("parent_receptacle"),
        )
    )


def unique_detections(detections: DataFrame) -> DataFrame:
    """One row per (step, object): first place in the order, last box.

    Side by side, the numbers fit a hash aggregate; a struct of them would be sorted.
    """
    return detections.groupBy(*STEP, "object_id").agg(
        F.min("det_ord").alias("det_ord"), *[F.max_by(b, "det_ord").alias(b) for b in BOX]
    )


def _with_states(detections: DataFrame, states: DataFrame) -> DataFrame:
    """Unique detections with their states as ``__state``, dealt by step.

    Both are shuffled once, by step, and meet in one aggregate; what is joined by step later finds the rows in
    place. A join by step and object would deal them anew.
    """
    seen = detections.select(*STEP, "object_id", "det_ord", *BOX, F.lit(None).alias("__s"), F.lit(1).alias("__seen"))
    state = states
    for key in (*STEP, "object_id"):
        state = state.where(F.col(key).isNotNull())
    none = [F.lit(None).cast(detections.schema[c].dataType).alias(c) for c in ("det_ord", *BOX)]
    state = state.select(*STEP, "object_id", *none, _state().alias("__s"), F.lit(None).alias("__seen"))
    return (
        seen.unionByName(state)
        .repartition(*STEP)
        .groupBy(*STEP, "object_id")
        .agg(
            F.min("det_ord").alias("det_ord"),
            *[F.max_by(b, "det_ord").alias(b) for b in BOX],
            F.count("__seen").alias("__seen"),
            # One, unless rows of the state log are repeated.
            F.collect_list("__s").alias("__states"),
        )
        .where(F.col("__seen") > 0)
        .select(*STEP, "object_id", "det_ord", *BOX, F.explode_outer("__states").alias("__state"))
    )


def local_position(params: Params = DEFAULTS) -> Column:
    return G.world_to_local(point("cam"), F.col("pitch_deg"), F.col("yaw_deg"), point("pos"))


def visible_objects(
    steps: DataFrame,
    detections: DataFrame,
    states: DataFrame,
    objects: DataFrame,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Every detected object with its camera-frame position, pixel, bearings and box."""
    camera = steps.select(*STEP, "pos", "cam_x", "cam_y", "cam_z", "pitch_deg", "yaw_deg")
    # The camera comes first, while the rows still lie by step.
    shot = _with_states(detections, states).join(camera, STEP)
    columns = [*STEP, "object_id", "det_ord", *BOX, *camera.columns[2:]]
    placed = _posed(shot, objects, columns).withColumn("__local", local_position(params))
    local = F.col("__local")
    placed = placed.withColumns(
        {
            "__angles": G.bearing_angles(local),
            "__pixel": G.project_pinhole(local, params),
            "__bbox": valid_bbox_detect(*[F.col(b) for b in BOX]),
        }
    )
    return placed.select(
        *STEP,
        "pos",
        "det_ord",
        "object_id",
        "category",
        *[f"pos_{a}" for a in "xyz"],
        *[f"rot_{a}" for a in "xyz"],
        *[G.round_half_even(local[a], 3).alias(f"local_{a}") for a in "xyz"],
        *[G.round_half_even(F.col(f"__pixel.{c}"), 3).alias(f"px_{c}") for c in "uv"],
        *[G.round_half_even(F.col(f"__angles.{c}"), 3).alias(c) for c in ("alpha", "beta")],
        *[F.col(f"__bbox.{b}").alias(b) for b in BOX],
        "from_state",
        "in_camera_fov",
        "parent_receptacle",
    )


def bbox_fallback(visible: DataFrame, nav_bboxes: DataFrame) -> DataFrame:
    """Box of the visible object if it is a drawable one, else the navigation log's."""
    nav = nav_bboxes.select(*STEP, "object_id", F.struct(*BOX).alias("__nav"))
    box = F.coalesce(valid_bbox_marker(*[F.col(b) for b in BOX]), F.col("__nav"))
    rest = [c for c in visible.columns if c not in BOX]
    return (
        visible.join(nav, [*STEP, "object_id"], "left")
        .withColumn("__box", box)
        .select(*rest, *[F.col("__box")[b].alias(b) for b in BOX])
    )
