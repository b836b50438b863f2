"""Collector records to log rows and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.functions.geometry import round_half_even, round_pose

def _kept(objects: str = "objects", detections: str = "detections"):
    """Objects that are visible and have a detection box."""
    return F.filter(
        objects,
        lambda o: o["visible"] & F.exists(detections, lambda d: d["object_id"] == o["object_id"]),
    )


def flatten_records(records: DataFrame) -> DataFrame:
    """Agent state with its list of objects to one row per detection.

    A step without detections keeps one row with null object columns.
    """

    def row(o):
        box = F.filter("detections", lambda d: d["object_id"] == o["object_id"])[0]
        return F.struct(
            o["object_id"].alias("object_id"),
            round_half_even(o["distance"], 4).alias("distance"),
            *[box[b].alias(b) for b in ("cmin", "rmin", "cmax", "rmax")],
        )

    agent = [c for c in records.columns if c not in ("objects", "detections")]
    return (
        records.withColumn("__rows", F.transform(_kept(), row))
        .select(*agent, F.posexplode_outer("__rows").alias("det_ord", "__o"))
        .select(*agent, "det_ord", "__o.*")
    )


def build_catalog(records: DataFrame) -> DataFrame:
    """Distinct observed object tuples: set semantics over all steps.

    A tuple holds id, category, pose, colour, receptacle list, box centre and box size; what the records
    do not have is null. Two sightings that differ in any of these are two tuples.
    """
    seen = records.select("episode_id", F.explode(_kept()).alias("o"))
    known = seen.schema["o"].dataType.names

    def own(name, kind):
        return F.col(f"o.{name}") if name in known else F.lit(None).cast(kind)

    vector = "struct<x:double,y:double,z:double>"
    poses = {"pos": "position", "rot": "rotation", "center": "box_center", "size": "box_size"}
    rounded = {short: round_pose(own(name, vector), 2) for short, name in poses.items()}
    return seen.select(
        "episode_id",
        F.col("o.object_id").alias("object_id"),
        F.col("o.category").alias("category"),
        own("color", "string").alias("color"),
        own("receptacle_object_ids", "array<string>").alias("receptacle_object_ids"),
        *[p[a].alias(f"{short}_{a}") for short, p in rounded.items() for a in "xyz"],
    ).dropDuplicates()
