"""Nested views of the flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.operators.edges import EDGE_TYPES
from roamframe.operators.poses import STEP
from roamframe.ordered import BLOCK, step_block

HEADER = [
    "image_path",
    "action",
    "degrees",
    "cam_x",
    "cam_y",
    "cam_z",
    "pitch_deg",
    "yaw_deg",
    "roll_deg",
    "region_id",
    "region_type",
]


def step_headers(nav: DataFrame) -> DataFrame:
    """Rows of a raw log grouped by step: the first row gives the header, detections keep order.

    A step is one camera frame, so its detections are one frame long.
    """
    present = [c for c in HEADER if c in nav.columns]
    shown = F.struct("src_ord", "object_id", "cmin", "rmin", "cmax", "rmax")
    return (
        nav.groupBy(*STEP)
        .agg(
            F.min_by(F.struct(*present), "src_ord").alias("h"),
            F.sort_array(
                F.collect_list(F.when(F.col("object_id").isNotNull(), shown))
            ).alias("d"),
        )
        .select(
            *STEP,
            "h.*",
            F.transform("d", lambda o: o["object_id"]).alias("objects"),
            F.transform(
                "d", lambda o: F.struct(*[o[b].alias(b) for b in ("cmin", "rmin", "cmax", "rmax")])
            ).alias("bboxes"),
        )
    )


def _triple(prefix: str) -> Column:
    return F.array(*[F.col(f"{prefix}_{a}") for a in "xyz"])


def _object_order() -> Column:
    """An object of a step: its place among the others, and its entry in the map of the step."""
    bbox = F.when(F.col("cmin").isNotNull(), F.array("cmin", "rmin", "cmax", "rmax"))
    entry = F.struct(
        "object_id",
        F.struct(
            "category",
            _triple("pos").alias("position"),
            F.when(F.col("local_x").isNotNull(), _triple("local")).alias("local_position"),
            F.when(F.col("px_u").isNotNull(), F.array("px_u", "px_v")).alias("local_point"),
            F.when(F.col("alpha").isNotNull(), F.array("alpha", "beta")).alias("angles"),
            bbox.alias("bbox"),
            "last_seen_step",
            "in_camera_fov",
            "parent_receptacle",
        ).alias("data"),
    )
    return F.struct(
        F.coalesce("first_step", F.lit(0)).alias("a"),
        F.coalesce("det_ord", "first_det_ord").alias("b"),
        entry.alias("e"),
    )


def _edge_entry() -> Column:
    return F.struct(
        "ord_major",
        "ord_minor",
        F.struct(
            "source",
            "target",
            "distance_metric",
            "distance_label",
            "visible",
            F.array("angle_x", "angle_y", "angle_z").alias("angle_relation"),
            "inferred",
            "last_seen",
        ).alias("edge"),
    )


VISIBILITY = ("visible", "non_visible")
STEP_VALUES = ("image_path", "action", "degrees", "agent", "current_room", "current_room_type")
NESTED = (*[f"{v}_objects" for v in VISIBILITY], *[f"edges_{k}" for k in EDGE_TYPES])


def _parts_met(
    steps: DataFrame, objects: DataFrame, edges: DataFrame, by: dict[str, Column], more: DataFrame | None = None
) -> DataFrame:
    """Headers (``heads``), objects and edges of each step, each kind as lists.

    Flat rows of all kinds are dealt once, by ``by``, and gathered where they lie: lists of nested values are
    several times larger than the rows they come from.  ``more`` are rows that have the columns of ``by`` and a
    struct ``x``, gathered as ``extra``; they belong to no step.
    """
    head = F.struct(
        "image_path",
        "action",
        "degrees",
        F.struct(
            _triple("cam").alias("position"),
            F.array("pitch_deg", "yaw_deg", "roll_deg").alias("rotation"),
        ).alias("agent"),
        F.col("region_id").alias("current_room"),
        F.col("region_type").alias("current_room_type"),
    )
    keyed = F.col("episode_id").isNotNull() & F.col("step").isNotNull()
    keys = [*dict.fromkeys([*by, *STEP])]
    key = [by[k].alias(k) if k in by else F.col(k) for k in keys]
    rows = steps.select(*key, head.alias("h"))
    shown = objects.where(keyed).select(*key, "visibility", _object_order().alias("o"))
    related = edges.where(keyed).select(*key, "edge_type", _edge_entry().alias("e"))
    rows = rows.unionByName(shown, allowMissingColumns=True).unionByName(related, allowMissingColumns=True)
    extra = []
    if more is not None:
        rows = rows.unionByName(more, allowMissingColumns=True)
        extra = [F.collect_list("x").alias("extra")]
    return (
        rows.repartition(*by)
        .groupBy(*keys)
        .agg(
            F.collect_list("h").alias("heads"),
            F.count("o").alias("n_objects"),
            F.count("e").alias("n_edges"),
            *[F.collect_list(F.when(F.col("visibility") == v, F.col("o"))).alias(f"o_{v}") for v in VISIBILITY],
            *[F.collect_list(F.when(F.col("edge_type") == k, F.col("e"))).alias(f"e_{k}") for k in EDGE_TYPES],
            *extra,
        )
    )


def _nested_parts() -> list[Column]:
    """Object maps and edge lists over what :func:`_parts_met` gathered; null where a step has none at all."""
    maps = [
        F.when(
            F.col("n_objects") > 0,
            F.map_from_entries(F.transform(F.sort_array(f"o_{v}"), lambda o: o["e"])),
        ).alias(f"{v}_objects")
        for v in VISIBILITY
    ]
    lists = [
        F.when(
            F.col("n_edges") > 0, F.transform(F.sort_array(f"e_{k}"), lambda e: e["edge"])
        ).alias(f"edges_{k}")
        for k in EDGE_TYPES
    ]
    return maps + lists


def assemble_steps(steps: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested row per step: pose, object maps and the four edge lists."""
    met = _parts_met(steps, objects, edges, {k: F.col(k) for k in STEP})
    return met.withColumn("h", F.explode("heads")).select(*STEP, "h.*", *_nested_parts())


# Nested steps are heavy, so a part of an episode holds fewer of them than a block of plain rows.
STEPS_PER_PART = BLOCK // 16


def _by_step(a: Column, b: Column) -> Column:
    return (a["step"] - b["step"]).cast("int")


def sort_steps(steps: DataFrame, per_part: int = STEPS_PER_PART) -> DataFrame:
    """Steps of an episode as ordered arrays, in parts of at most ``per_part`` steps."""
    rest = [c for c in steps.columns if c not in STEP]
    return (
        steps.withColumn("part", step_block("step", per_part).cast("int"))
        .groupBy("episode_id", "part")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("step", *rest)),
                _by_step,
            ).alias("steps")
        )
    )


def assemble_episodes(
    episodes: DataFrame,
    steps: DataFrame,
    objects: DataFrame,
    edges: DataFrame,
    per_part: int = STEPS_PER_PART,
) -> DataFrame:
    """Episodes with their nested steps as ordered arrays, in parts of at most ``per_part`` steps.

    Rows are dealt once, by part; steps are made, put in order and given their episode's columns where they lie.
    """
    part = step_block("step", per_part).cast("int")
    # Steps of no episode are in no result; an episode without steps is one row without a part.
    steps = steps.where(F.col("episode_id").isNotNull())
    parts = steps.select("episode_id", part.alias("part")).distinct()
    about = episodes.join(parts, "episode_id", "left").select(
        "episode_id", "part", F.lit(None).cast(steps.schema["step"].dataType).alias("step"), F.struct(*episodes.columns).alias("x")
    )
    met = _parts_met(steps, objects, edges, {"episode_id": F.col("episode_id"), "part": part}, about)
    step = F.transform("heads", lambda h: F.struct("step", *[h[c].alias(c) for c in STEP_VALUES], *NESTED))
    return (
        met.select("episode_id", "part", "step", "heads", "extra", *_nested_parts())
        .select("episode_id", "part", "extra", step.alias("steps"))
        .groupBy("episode_id", "part")
        .agg(F.flatten(F.collect_list("extra")).alias("extra"), F.flatten(F.collect_list("steps")).alias("steps"))
        .select("part", "steps", F.explode("extra").alias("x"))
        .select(
            *[F.col("x")[c].alias(c) for c in episodes.columns],
            "part",
            F.when(F.size("steps") > 0, F.array_sort("steps", _by_step)).alias("steps"),
        )
    )


def json_payload(df: DataFrame, keys: list[str], name: str = "payload_json") -> DataFrame:
    """Key columns and the whole row as JSON text."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias(name))


def from_payload(df: DataFrame, schema, name: str = "payload_json") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("r")).select("r.*")
