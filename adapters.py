"""The given tables seen as episode logs.

``events`` become steps, detections, states and passages, ``embeddings`` the object catalog,
``nation`` the room graph and ``region`` the landmarks of the layout.  A user is an episode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.operators.aggregates import displaced_ids
from roamframe.operators.tracks import object_state_track
from roamframe.ordered import row_number, with_ordered
from roamframe.plans.facts import plan_all
from roamframe.plans.tables import EpisodeTables, derive
from roamframe.storage import saved

SCENES = ["house_000001", "house_000002"]


def scene_of(episode_id: str = "episode_id") -> F.Column:
    """Episodes take the scenes in turn; both have the same layout."""
    return F.when(F.col(episode_id) % 2 == 0, SCENES[0]).otherwise(SCENES[1])


def _of_scenes(layout: DataFrame) -> DataFrame:
    return layout.select(F.explode(F.array(*[F.lit(s) for s in SCENES])).alias("scene_id"), "*")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zero_rotation() -> dict:
    return {f"rot_{a}": F.lit(0.0) for a in "xyz"}


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"), "event_id", "ts", "event_type", "value"
    )
    hour = F.datediff("ts", F.lit("1970-01-01")) * 24 + F.hour("ts")
    numbered = with_ordered(
        events, ["episode_id"], ["ts", "event_id"], hour, {"n": row_number()}
    )
    step = (F.col("n") - 1).cast("int")
    action = (
        F.when(F.col("event_type") == "click", "move_ahead")
        .when(F.col("event_type") == "view", "rotate_right")
        .when(F.col("event_type") == "purchase", "rotate_left")
        .when(F.col("event_type") == "signup", "done")
        .otherwise("pickup")
    )
    cents = F.round(F.col("value") * 100).cast("bigint")
    room = F.floor((F.day("ts") - 1) / 12.0).cast("int") % 4
    return numbered.select(
        "episode_id",
        step.alias("step"),
        step.alias("pos"),
        "event_id",
        F.concat(F.lit("img_"), step.cast("string"), F.lit(".png")).alias("image_path"),
        action.alias("action"),
        F.when(F.col("event_type").isin("view", "purchase"), 90).otherwise(0).alias("degrees"),
        ((cents % 500).cast("double") / 100).alias("cam_x"),
        F.lit(1.0).alias("cam_y"),
        ((F.col("event_id") * 37 % 500).cast("double") / 100).alias("cam_z"),
        ((F.col("event_id") % 3 - 1) * 30).cast("double").alias("pitch_deg"),
        (F.col("event_id") % 8 * 45).cast("double").alias("yaw_deg"),
        F.lit(0.0).alias("roll_deg"),
        F.concat(F.lit("room|"), room.cast("string")).alias("region_id"),
        F.lit(None).cast("string").alias("region_type"),
    )


def _catalog_size(spark: SparkSession, sf_dir: str) -> F.Column:
    return _table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()


def detections(spark: SparkSession, sf_dir: str, step_rows: DataFrame) -> DataFrame:
    e, d = F.col("event_id"), F.col("det_ord")
    number = (F.col("episode_id") * 17 + (e * 7 + d * 5) % 12) % F.col("n_objects")
    shown = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < e % 4)
    return (
        step_rows.select("episode_id", "step", "event_id", F.explode(shown).alias("det_ord"))
        .withColumn("n_objects", _catalog_size(spark, sf_dir))
        .select(
            "episode_id",
            "step",
            "det_ord",
            F.concat(F.lit("Obj|"), number.cast("string")).alias("object_id"),
            (e % 300).cast("int").alias("cmin"),
            (e % 150).cast("int").alias("rmin"),
            (e % 300 + 20 + d).cast("int").alias("cmax"),
            (e % 150 + 30).cast("int").alias("rmax"),
        )
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return (
        _table(spark, sf_dir, "embeddings")
        .select(
            F.concat(F.lit("Obj|"), F.col("vec_id").cast("string")).alias("object_id"),
            F.when(F.col("label") == 0, "Undefined")
            .otherwise(F.concat(F.lit("Type"), F.col("label").cast("string")))
            .alias("category"),
            (at(0) * 5 + 2.5).alias("pos_x"),
            (at(1) * 2 + 1).alias("pos_y"),
            (at(2) * 5 + 2.5).alias("pos_z"),
        )
        .withColumns(_zero_rotation())
    )


def states(
    spark: SparkSession, sf_dir: str, step_rows: DataFrame, seen: DataFrame, catalog: DataFrame
) -> DataFrame:
    """One displaced object per episode, moved every 20 steps."""
    number = (F.col("episode_id") * 17 + 3) % F.col("n_objects")
    shelf = F.floor(F.col("step") / 20.0).cast("int")
    moved = (
        step_rows.select("episode_id", "step")
        .withColumn("n_objects", _catalog_size(spark, sf_dir))
        .select(
            "episode_id",
            "step",
            F.concat(F.lit("Obj|"), number.cast("string")).alias("object_id"),
        )
    )
    fov = seen.select("episode_id", "step", "object_id", F.lit(True).alias("in_view"))
    return (
        moved.join(fov, ["episode_id", "step", "object_id"], "left")
        .join(catalog, "object_id")
        .select(
            "episode_id",
            "step",
            "object_id",
            "category",
            (F.col("pos_x") + shelf * 0.25).alias("pos_x"),
            "pos_y",
            "pos_z",
            "rot_x",
            "rot_y",
            "rot_z",
            F.col("in_view").isNotNull().alias("visible"),
            F.col("in_view").isNotNull().alias("in_camera_fov"),
            F.concat(F.lit("CounterTop|"), (shelf % 3).cast("string")).alias("parent_receptacle"),
            F.lit(False).alias("is_inside_receptacle"),
            F.lit(None).cast("boolean").alias("receptacle_is_open"),
        )
    )


def displacement_events(state_rows: DataFrame) -> DataFrame:
    before = state_rows.select(
        "episode_id",
        "object_id",
        (F.col("step") + 1).alias("step"),
        F.col("parent_receptacle").alias("from_receptacle"),
    )
    return (
        state_rows.where(F.col("step") % 20 == 0)
        .join(before, ["episode_id", "object_id", "step"])
        .select(
            "episode_id",
            F.col("step").alias("event_ord"),
            F.concat_ws("_", F.lit("move"), "episode_id", "step").alias("event_id"),
            F.col("step").alias("at_timestep"),
            "object_id",
            "from_receptacle",
            F.col("parent_receptacle").alias("to_receptacle"),
            (~F.col("in_camera_fov")).alias("hidden_during"),
        )
    )


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(
        key.cast("int").alias("row_ord"),
        F.concat(F.lit("room|"), key.cast("string")).alias("from_region"),
        F.concat(F.lit("room|"), ((key * 3 + 1) % 25).cast("string")).alias("to_region"),
        F.col("n_name").alias("passage_id"),
        (key % 5 != 0).alias("bidirectional"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(
        key.cast("int").alias("row_ord"),
        F.concat(F.lit("room|"), key.cast("string")).alias("region_id"),
        F.when(key % 4 != 3, F.concat(F.lit("Hall "), key.cast("string"))).alias("label"),
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey").cast("string")
    return _table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("int").alias("row_ord"),
        F.concat(F.lit("Shelf"), key, F.lit("|"), key).alias("landmark_id"),
        F.lit("Shelf").alias("category"),
        F.concat(F.lit("room|"), key).alias("region_id"),
    )


def passage_state(step_rows: DataFrame) -> DataFrame:
    e = F.col("event_id")
    door = F.concat(F.lit("door|"), (e % 3).cast("string"))
    return step_rows.select(
        "episode_id",
        F.col("step").alias("timestep"),
        door.alias("passage_id"),
        door.alias("object_id"),
        (e % 5 < 2).alias("is_open"),
        F.when(e % 7 != 0, e % 2 == 0).alias("is_locked"),
        F.col("region_id").alias("from_region"),
        F.lit("room|3").alias("to_region"),
    )


_built: dict[tuple[str, str], EpisodeTables] = {}
_derived: dict[tuple[str, str], EpisodeTables] = {}


def base(spark: SparkSession, sf_dir: str) -> EpisodeTables:
    """Canonical tables, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        step_rows = saved(steps(spark, sf_dir), "steps")
        seen = saved(detections(spark, sf_dir, step_rows), "detections")
        catalog = saved(objects(spark, sf_dir), "objects")
        state_rows = saved(states(spark, sf_dir, step_rows, seen, catalog), "states")
        _built[key] = EpisodeTables(
            episodes=step_rows.select("episode_id")
            .distinct()
            .withColumns({"scene_id": scene_of(), "environment": F.lit("ai2thor")}),
            steps=step_rows,
            detections=seen,
            objects=catalog,
            states=state_rows,
            events=saved(displacement_events(state_rows), "events"),
            region_trajectory=step_rows.select(
                "episode_id", F.col("step").alias("timestep"), "region_id", "region_type"
            ),
            regions=_of_scenes(regions(spark, sf_dir)),
            landmarks=_of_scenes(landmarks(spark, sf_dir)),
            connectivity=_of_scenes(connectivity(spark, sf_dir)),
        )
    return _built[key]


def derived(spark: SparkSession, sf_dir: str) -> EpisodeTables:
    """Canonical and derived tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _derived:
        _derived[key] = derive(base(spark, sf_dir), keep=saved)
    return _derived[key]


def displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return displaced_ids(base(spark, sf_dir).events)


_facts: dict[tuple[str, str], DataFrame] = {}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planned facts, stored like the other tables before items are worded."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _facts:
        _facts[key] = saved(plan_all(derived(spark, sf_dir)), "facts")
    return _facts[key]


_tracks: dict[tuple[str, str], DataFrame] = {}


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse state track of displaced objects."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tracks:
        t = base(spark, sf_dir)
        _tracks[key] = saved(object_state_track(t.states, t.objects), "track")
    return _tracks[key]
