"""Readers of the raw episode logs (CSV).

Columns are found by header name, file by file: the files of one call may have different columns in
different orders, and what a file lacks is null.  Every row carries its episode and ``src_ord``, its
place in the file.

``episode`` is a pattern that finds the episode's folder in the path of a file.  With None a file holds
many episodes, each of them whole, and names them in a column ``episode_id``: a folder and a file per
episode are too many to list and open where there are hundreds of thousands of episodes.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roamframe.functions.clean import is_structural, is_valid_id, parse_bool
from roamframe.operators.assemble import HEADER
from roamframe.operators.poses import dedup_last
from roamframe.operators.tracks import passage_change_points, region_change_points
from roamframe.ordered import row_number, step_block, with_ordered

# Texts a table reader takes as "missing".
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Column layouts that one call takes.
LAYOUTS = 100

# Folder that holds the episode: the parent of ``annotations/``, or of the file itself.
EPISODE_FOLDER = r"([^/]+)/(?:annotations/)?[^/]+$"


def _place() -> Column:
    """Order of a row in its file: start of its split in MiB, then place within the split."""
    split = F.floor(F.col("_metadata.file_block_start") / 1048576)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(split, 33) + within


def read_log(
    spark: SparkSession, path: str | Sequence[str], episode: str | None = EPISODE_FOLDER
) -> DataFrame:
    """Text columns of a log, missing values as null, plus episode_id, src_file and src_ord.

    A first pass takes the header line of every file.  Files of one layout go through the CSV reader;
    of several, the lines of each layout are parsed by its own header and the rows put together.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    file = F.col("_metadata.file_path")
    headers = (
        lines.where(F.col("_metadata.file_block_start") == 0)
        .select(file.alias("src_file"), F.monotonically_increasing_id().alias("__n"), "value")
        .groupBy("src_file")
        .agg(F.min_by("value", "__n").alias("__header"))
    )
    # As many as there are layouts, not files.
    layouts = [r[0] for r in headers.select("__header").distinct().limit(LAYOUTS + 1).collect()]
    if len(layouts) > LAYOUTS:
        raise ValueError(f"more than {LAYOUTS} column layouts in one call")
    if len(layouts) == 1:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in _names(layouts[0])])
        options = dict(header=True, recursiveFileLookup=True, quote='"', escape='"')
        raw = spark.read.options(**options).schema(schema).csv(paths)
        rows = raw.select(file.alias("src_file"), _place().alias("src_ord"), "*")
    else:
        placed = lines.select(file.alias("src_file"), _place().alias("src_ord"), "value")
        # Header lines go before anything else looks at the text.
        placed = placed.where(~F.col("value").isin(layouts) & (F.trim("value") != ""))
        placed = placed.join(headers, "src_file")

        def of(header: str) -> DataFrame:
            kind = ", ".join(f"`{n}` string" for n in _names(header))
            mine = F.col("__header") == header
            # Lines of other layouts must never be parsed by this header, wherever a filter ends up.
            text = F.when(mine, F.col("value"))
            own = F.from_csv(text, kind, {"quote": '"', "escape": '"'}).alias("r")
            return placed.where(mine).select("src_file", "src_ord", own).select(
                "src_file", "src_ord", "r.*"
            )

        rows = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True), map(of, sorted(layouts))
        )
    names = [c for c in rows.columns if c not in ("src_file", "src_ord")]
    if episode is None:
        if "episode_id" not in names:
            raise ValueError("logs of many episodes need a column episode_id")
        own = F.col("episode_id")
        names.remove("episode_id")
    else:
        own = F.regexp_extract("src_file", episode, 1)
    clean = [
        F.when(~F.trim(F.col(f"`{n}`")).isin(MISSING), F.col(f"`{n}`")).alias(n) for n in names
    ]
    return rows.select(own.alias("episode_id"), "src_file", "src_ord", *clean)


def _names(header: str) -> list[str]:
    return next(csv.reader([header]))


def _col(df: DataFrame, name: str, type_: str = "string") -> Column:
    """Column by name, null where the layout does not have it."""
    if name not in df.columns:
        return F.lit(None).cast(type_)
    return F.col(f"`{name}`") if type_ == "string" else F.col(f"`{name}`").cast(type_)


def _int(df: DataFrame, name: str) -> Column:
    return _col(df, name, "double").cast("int")


def _number(df: DataFrame, name: str) -> Column:
    """A missing coordinate is NaN, as in the log."""
    return F.coalesce(_col(df, name, "double"), F.lit(float("nan")))


def _pose(df: DataFrame, source: str, target: str) -> list[Column]:
    return [_number(df, f"{source}-{a}").alias(f"{target}_{a}") for a in "xyz"]


def read_navigation(spark: SparkSession, path, episode: str | None = EPISODE_FOLDER) -> DataFrame:
    """One row per logged row; ``object_id`` is null where nothing usable was detected.

    Structural and invalid ids leave their step in place.
    """
    raw = read_log(spark, path, episode)
    id_ = _col(raw, "obj-id")
    usable = is_valid_id(id_) & ~is_structural(None, id_)
    held = _col(raw, "held_obj-id")
    return raw.select(
        "episode_id",
        _int(raw, "timestep").alias("step"),
        "src_ord",
        F.col("src_ord").alias("det_ord"),
        _col(raw, "ag-action").alias("action"),
        _col(raw, "degrees", "double").alias("degrees"),
        parse_bool(_col(raw, "action_success"), missing=None).alias("action_success"),
        F.when(F.trim(held) != "", held).alias("held_object_id"),
        *_pose(raw, "camera-pos", "cam"),
        _number(raw, "camera-horizon").alias("pitch_deg"),
        _number(raw, "ag-rot-y").alias("yaw_deg"),
        _number(raw, "ag-rot-z").alias("roll_deg"),
        _col(raw, "path").alias("image_path"),
        _col(raw, "current-room").alias("region_id"),
        _col(raw, "current-room-type").alias("region_type"),
        F.when(usable, id_).alias("object_id"),
        *[_col(raw, c, "double").alias(c) for c in ("cmin", "rmin", "cmax", "rmax")],
    )


def split_navigation(nav: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, detections): the first row of a step is its header."""
    head = [*HEADER, "action_success", "held_object_id"]
    steps = (
        nav.groupBy("episode_id", "step")
        .agg(F.min_by(F.struct(*head), "src_ord").alias("h"))
        .select("episode_id", "step", "h.*")
    )
    steps = with_ordered(
        steps, ["episode_id"], ["step"], step_block("step"), {"pos": row_number()}
    ).withColumn("pos", F.col("pos") - 1)
    detections = nav.where(F.col("object_id").isNotNull()).select(
        "episode_id", "step", "det_ord", "object_id", "cmin", "rmin", "cmax", "rmax"
    )
    return steps, detections


def parse_id_list(text: Column) -> Column:
    """List literal to array; bad text gives an empty array."""
    body = F.regexp_extract(text, r"^\s*[\[\(](.*)[\]\)]\s*$", 1)
    quoted = r"""^\s*(?:(?:'[^']*'|"[^"]*")\s*(?:,\s*|$))*$"""
    items = F.regexp_extract_all(body, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
    inner = F.transform(items, lambda s: F.substr(s, F.lit(2), F.length(s) - 2))
    return F.when(
        text.isNotNull() & body.rlike(quoted), inner
    ).otherwise(F.array().cast("array<string>"))


def read_objects(spark: SparkSession, path, episode: str | None = EPISODE_FOLDER) -> DataFrame:
    """Object catalog; the last row of an id wins."""
    raw = read_log(spark, path, episode)
    id_, type_ = _col(raw, "obj-id"), _col(raw, "obj-type")
    rows = raw.where(is_valid_id(id_) & ~is_structural(type_, id_)).select(
        "episode_id",
        id_.alias("object_id"),
        "src_ord",
        type_.alias("category"),
        _col(raw, "obj-color").alias("color"),
        *_pose(raw, "obj-pos", "pos"),
        *_pose(raw, "obj-rot", "rot"),
        parse_id_list(_col(raw, "receptacleObjectIds")).alias("receptacle_object_ids"),
        *_pose(raw, "bBox-center", "center"),
        *_pose(raw, "size", "size"),
    )
    return dedup_last(rows, ["episode_id", "object_id"], "src_ord").drop("src_ord")


def read_object_state(
    spark: SparkSession, path, displaced: DataFrame, episode: str | None = EPISODE_FOLDER
) -> DataFrame:
    """States of displaced objects; the last row of a (step, object) wins."""
    raw = read_log(spark, path, episode)
    rows = raw.select(
        "episode_id",
        _int(raw, "timestep").alias("step"),
        _col(raw, "obj-id").alias("object_id"),
        "src_ord",
        _col(raw, "obj-type").alias("category"),
        *_pose(raw, "obj-pos", "pos"),
        *_pose(raw, "obj-rot", "rot"),
        parse_bool(_col(raw, "visible")).alias("visible"),
        parse_bool(_col(raw, "in_camera_fov")).alias("in_camera_fov"),
        _col(raw, "parent_receptacle").alias("parent_receptacle"),
        parse_bool(_col(raw, "is_inside_receptacle")).alias("is_inside_receptacle"),
        parse_bool(_col(raw, "receptacle_is_open"), missing=None).alias("receptacle_is_open"),
        _col(raw, "distance_from_agent", "double").alias("distance_from_agent"),
    ).join(displaced, ["episode_id", "object_id"], "left_semi")
    return dedup_last(rows, ["episode_id", "step", "object_id"], "src_ord")


def read_displacement_events(spark: SparkSession, path, episode: str | None = EPISODE_FOLDER) -> DataFrame:
    raw = read_log(spark, path, episode)
    flags = (
        "hidden_during",
        "visible_just_before",
        "visible_just_after",
        "in_fov_just_before",
        "in_fov_just_after",
    )
    return raw.select(
        "episode_id",
        F.col("src_ord").alias("event_ord"),
        _col(raw, "event_id").alias("event_id"),
        _col(raw, "obj-id").alias("object_id"),
        _int(raw, "at_timestep").alias("at_timestep"),
        _col(raw, "action").alias("action"),
        _col(raw, "from_receptacle").alias("from_receptacle"),
        _col(raw, "to_receptacle").alias("to_receptacle"),
        *_pose(raw, "from_pos", "from_pos"),
        *_pose(raw, "to_pos", "to_pos"),
        *[parse_bool(_col(raw, f)).alias(f) for f in flags],
        _col(raw, "moved_via").alias("moved_via"),
        _col(raw, "notes").alias("notes"),
    )


# Rows of a file are blocked by their place in it, 2^20 rows at a time.
_FILE_BLOCK = 1 << 20


def _file_block() -> Column:
    return F.floor(F.col("src_ord") / _FILE_BLOCK)


def read_passage_state(spark: SparkSession, path, episode: str | None = EPISODE_FOLDER) -> DataFrame:
    """Change points per passage, in file order."""
    raw = read_log(spark, path, episode)
    rows = raw.select(
        "episode_id",
        _int(raw, "timestep").alias("timestep"),
        "src_ord",
        _col(raw, "passage_id").alias("passage_id"),
        _col(raw, "obj-id").alias("object_id"),
        parse_bool(_col(raw, "is_open")).alias("is_open"),
        parse_bool(_col(raw, "is_locked"), missing=None).alias("is_locked"),
        _col(raw, "from_region").alias("from_region"),
        _col(raw, "to_region").alias("to_region"),
    )
    return passage_change_points(rows, ["src_ord"], _file_block()).drop("src_ord")


def read_region_rows(spark: SparkSession, path, episode: str | None = EPISODE_FOLDER) -> DataFrame:
    raw = read_log(spark, path, episode)
    return raw.select(
        "episode_id",
        _int(raw, "timestep").alias("timestep"),
        "src_ord",
        _col(raw, "region_id").alias("region_id"),
        _col(raw, "region_type").alias("region_type"),
    )


def read_region_trajectory(spark: SparkSession, path, episode: str | None = EPISODE_FOLDER) -> DataFrame:
    """Change points of the agent's region, in file order."""
    rows = read_region_rows(spark, path, episode)
    return region_change_points(rows, ["src_ord"], _file_block()).drop("src_ord")
