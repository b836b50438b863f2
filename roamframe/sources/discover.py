"""Which files belong to which episode, and where the images are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.sources.layout import scene_from_name

# File roles and their extensions.
ROLES = {
    "navigation": "csv",
    "objects": "csv",
    "object_state": "csv",
    "displacement_events": "csv",
    "passage_state": "csv",
    "region_trajectory": "csv",
    "world_layout": "json",
    "episode_meta": "json",
    "doors": "csv",
}
REQUIRED = ["navigation", "objects"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths under ``root``; only the path column is read, never the content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )


def plain_path(path):
    """A path without scheme and host, so that listed, logged and named paths compare."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)", "")


def _split(listing: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return listing.select(
        "path", folder.alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")
    )


def discover(
    listing: DataFrame,
    overrides: Mapping[str, str] | None = None,
    meta: DataFrame | None = None,
) -> DataFrame:
    """One row per episode folder with one path column per role.

    ``listing`` has a ``path`` column.  A folder is an episode if it, or its ``annotations/``
    subfolder, holds a navigation or meta file; the subfolder comes first.  The scene is read from
    the meta file's name, else from the first navigation file's; ``meta`` (``path``, ``scene_id``,
    ``images_dir``) overrides it.  ``missing`` names required roles without a file.
    """
    overrides = dict(overrides or {})
    files = _split(listing)
    anchor = F.regexp_extract("name", r"^(navigation-.*\.csv|episode_meta-.*\.json)$", 1) != ""
    nested = F.col("folder").rlike("(^|/)annotations$")
    root = F.when(nested, F.regexp_extract("folder", r"^(.*)/[^/]*$", 1)).otherwise(
        F.col("folder")
    )
    is_meta = F.col("name").startswith("episode_meta-")
    folders = (
        files.where(anchor)
        .groupBy(root.alias("episode_root"), "folder")
        .agg(
            F.min(F.when(is_meta, F.col("name"))).alias("meta_name"),
            F.min(F.when(~is_meta, F.col("name"))).alias("nav_name"),
        )
    )
    chosen = (
        folders.groupBy("episode_root")
        .agg(
            F.max_by(
                F.struct("folder", "meta_name", "nav_name"),
                (F.col("folder") != F.col("episode_root")).cast("int"),
            ).alias("c")
        )
        .select(
            "episode_root",
            F.col("c.folder").alias("annotations_dir"),
            F.coalesce(
                scene_from_name(F.col("c.meta_name")), scene_from_name(F.col("c.nav_name"))
            ).alias("named_scene"),
        )
    )

    def wanted(role: str, scene: str):
        name = (
            F.lit(overrides[role])
            if role in overrides
            else F.concat(F.lit(f"{role}-"), F.col(scene), F.lit(f".{ROLES[role]}"))
        )
        return F.when(plain_path(name).startswith("/"), name).otherwise(
            F.concat(F.col("annotations_dir"), F.lit("/"), name)
        )

    if meta is not None:
        chosen = (
            chosen.withColumn("__plain", plain_path(wanted("episode_meta", "named_scene")))
            .join(
                meta.select(
                    plain_path(F.col("path")).alias("__plain"), F.col("scene_id").alias("meta_scene"), "images_dir"
                ),
                "__plain",
                "left",
            )
            .drop("__plain")
        )
    else:
        chosen = chosen.withColumns(
            {c: F.lit(None).cast("string") for c in ("meta_scene", "images_dir")}
        )
    chosen = chosen.withColumn(
        "scene_id", F.coalesce(F.when(F.col("meta_scene") != "", F.col("meta_scene")), "named_scene")
    )
    roles = F.array(
        *[
            F.struct(
                F.lit(r).alias("role"),
                # The meta file keeps the name it was found by.
                wanted(r, "named_scene" if r == "episode_meta" else "scene_id").alias("path"),
            )
            for r in ROLES
        ]
    )
    candidates = chosen.select("episode_root", F.explode(roles).alias("r")).select(
        "episode_root", "r.role", plain_path(F.col("r.path")).alias("__plain")
    )
    found = (
        candidates.join(listing.select(plain_path(F.col("path")).alias("__plain"), "path"), "__plain")
        .groupBy("episode_root")
        .pivot("role", list(ROLES))
        .agg(F.first("path"))
    )
    # Images: the named folder beside the logs if it holds a file, else ``images``.
    relative = F.coalesce(F.when(F.col("images_dir") != "", F.col("images_dir")), F.lit("images"))
    options = F.array(
        F.concat_ws("/", "episode_root", relative),
        F.concat_ws("/", F.regexp_extract("annotations_dir", r"^(.*)/[^/]*$", 1), relative),
        F.concat_ws("/", "episode_root", F.lit("images")),
        F.concat_ws("/", "annotations_dir", F.lit("images")),
    )
    places = chosen.select("episode_root", F.posexplode(options).alias("i", "folder"))
    images = (
        places.join(files.select("folder").distinct(), "folder", "left_semi")
        .groupBy("episode_root")
        .agg(F.min_by("folder", "i").alias("__images"))
    )
    missing = F.array_compact(
        F.array(*[F.when(F.col(r).isNull(), F.lit(r)) for r in REQUIRED])
    )
    return (
        chosen.join(found, "episode_root", "left")
        .join(images, "episode_root", "left")
        .select(
            "episode_root",
            "annotations_dir",
            "scene_id",
            F.coalesce("__images", F.concat_ws("/", "episode_root", F.lit("images"))).alias(
                "images_dir"
            ),
            *ROLES,
            missing.alias("missing"),
        )
    )


def require_roles(episodes: DataFrame) -> DataFrame:
    """Fail on an episode that lacks a required file."""
    message = F.concat(
        F.lit("required file missing for "),
        F.array_join("missing", ", "),
        F.lit(" in "),
        "annotations_dir",
    )
    return episodes.where(
        F.when(F.size("missing") > 0, F.raise_error(message).cast("boolean")).otherwise(True)
    )


def resolve_images(steps: DataFrame, listing: DataFrame) -> DataFrame:
    """Repaired image path per step.

    In turn: the logged path as it is, its base name and its relative path under the images folder,
    ``img_<step>.png`` there, else the logged text.  ``steps`` needs ``images_dir``; ``listing``
    has a ``path`` column.
    """
    logged = F.trim(F.coalesce("image_path", F.lit("")))
    text = F.when(F.lower(logged) == "nan", "").otherwise(logged)
    here = F.col("images_dir")
    # Distinct paths are looked up, not steps: frames repeat.
    rows = steps.withColumn("__text", text).withColumn(
        "__options",
        F.array(
            F.when(F.col("__text") != "", F.col("__text")),
            F.when(
                F.col("__text") != "",
                F.concat_ws("/", here, F.regexp_extract("__text", r"([^/]*)$", 1)),
            ),
            F.when(
                (F.col("__text") != "") & ~plain_path(F.col("__text")).startswith("/"),
                F.concat_ws("/", here, "__text"),
            ),
            F.concat(here, F.lit("/img_"), F.col("step").cast("string"), F.lit(".png")),
        ),
    )
    tried = rows.select(
        "episode_id", "step", F.posexplode("__options").alias("i", "path")
    ).where(F.col("path").isNotNull())
    there = listing.select(plain_path(F.col("path")).alias("__plain")).distinct()
    best = (
        tried.withColumn("__plain", plain_path(F.col("path")))
        .join(there, "__plain", "left_semi")
        .groupBy("episode_id", "step")
        .agg(F.min_by("path", "i").alias("__path"))
    )
    return (
        rows.join(best, ["episode_id", "step"], "left")
        .withColumn(
            "image_path", F.coalesce("__path", F.when(F.col("__text") != "", F.col("__text")))
        )
        .drop("__text", "__options", "__path")
    )
