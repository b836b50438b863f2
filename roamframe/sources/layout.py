"""Readers of layout and meta files (JSON).

``episode`` is a pattern that finds the episode's folder in the path of a file, which is one document.
With None a file holds one document per line, and each names its own in a field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.functions.text import environment_of, scene_of
from roamframe.sources.logs import EPISODE_FOLDER

POINT = "struct<x:double,y:double,z:double>"
LAYOUT_SCHEMA = (
    f"regions array<struct<region_id:string,label:string,center:{POINT},"
    "landmark_obj_ids:array<string>>>, "
    f"landmarks array<struct<landmark_id:string,`obj-type`:string,position:{POINT},"
    "region_id:string>>, "
    "passages array<struct<passage_id:string,`obj-id`:string,from_region:string,"
    "to_region:string,passage_type:string>>, "
    "connectivity array<struct<from_region:string,to_region:string,passage_id:string,"
    "bidirectional:boolean>>"
)
META_SCHEMA = (
    "episode_id string, episode_kind string, environment string, scene_id string, "
    "num_displacements int, num_tracked_objects int, images_dir string, annotations_dir string"
)


def _read(spark: SparkSession, path, schema: str, episode: str | None, name: str) -> DataFrame:
    """Documents and their files; the episode of each is in the column ``name``."""
    paths = [path] if isinstance(path, str) else list(path)
    file = F.col("_metadata.file_path").alias("src_file")
    reader = spark.read.options(multiLine=episode is not None, recursiveFileLookup=True)
    if episode is None:
        return reader.schema(f"{name} string, {schema}").json(paths).select("*", file)
    own = F.regexp_extract("_metadata.file_path", episode, 1).alias(name)
    return reader.schema(schema).json(paths).select(own, "*", file)


def read_world_layout(
    spark: SparkSession, path, episode: str | None = EPISODE_FOLDER
) -> dict[str, DataFrame]:
    """Tables ``regions``, ``landmarks``, ``passages`` and ``connectivity`` with their row order.

    In files of many layouts the field is ``scene_id``.
    """
    layouts = _read(spark, path, LAYOUT_SCHEMA, episode, "scene_id")
    out = {}
    for name in ("regions", "landmarks", "passages", "connectivity"):
        rows = layouts.select("scene_id", F.posexplode(name).alias("row_ord", "r")).select(
            "scene_id", "row_ord", "r.*"
        )
        for raw, tidy in (("obj-type", "category"), ("obj-id", "object_id")):
            if raw in rows.columns:
                rows = rows.withColumnRenamed(raw, tidy)
        out[name] = rows
    return out


def read_episode_meta(spark: SparkSession, path, episode: str | None = EPISODE_FOLDER) -> DataFrame:
    """One row per episode; the scene of the meta file overrides the one in its file name.

    In files of many metas the field is ``folder``.
    """
    meta = _read(spark, path, META_SCHEMA, episode, "folder")
    named = scene_from_name(F.regexp_extract("src_file", r"([^/]+)$", 1))
    return meta.withColumns(
        {
            "scene_id": scene_of(F.col("scene_id"), named),
            "environment": environment_of(F.col("environment")),
        }
    ).drop("src_file")


def scene_from_name(name):
    """``house_<digits>``, else the text after the first dash of a CSV or JSON name."""
    house = F.regexp_extract(name, r"(house_\d+)", 1)
    rest = F.regexp_extract(name, r"-(.+)\.(csv|json)$", 1)
    return F.when(house != "", house).when(rest != "", rest)
