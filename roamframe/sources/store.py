"""Episode tables on disk.

A store is a folder of Parquet tables partitioned by ``bucket``, a hash of the episode id, so that
an episode is found without listing millions of folders.

Every write is a version. Its files are written aside, under the version's number and a name of their
own, and count only once the version's manifest is there: one small file that names, for all tables
together, the folders that hold rows and the lists of replaced episodes. A write that dies before that leaves the
former version as it was. Replacing an episode writes its own rows and its id; rows of older versions are left out
when the table is read, until :func:`compact` writes the tables anew.
"""

from __future__ import annotations

import hashlib
import json as json_text
import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from roamframe.operators.aggregates import step_counts
from roamframe.operators.assemble import assemble_episodes
from roamframe.storage import cut, drop_aside, exists, moved, names_in, publish, published

TABLES = ("episodes", "steps", "step_objects", "edges", "route_landmarks", "route_turns")
# Pick the number of buckets so that one of them can be read in a reasonable time.
BUCKETS = 64
# So many asked ids are sent to all tasks; more of them are met in a shuffle.
FEW_IDS = 10_000


def bucket_of(episode_id, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(episode_id.cast("string")), F.lit(buckets)).cast("int")


def align(df: DataFrame, schema) -> DataFrame:
    """Add the columns of ``schema`` that old data lacks."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ],
        *[c for c in df.columns if c not in schema.names],
    )


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a store, the latest last."""
    names = names_in(spark, f"{path}/_versions")
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no such version of a store: {path}")
    return json_text.loads(published(spark, f"{path}/_versions/{version or known[-1]}.json"))


def stored_buckets(spark: SparkSession, path: str) -> int:
    """The number of buckets that a store was first written with."""
    return _manifest(spark, path)["buckets"] if versions(spark, path) else BUCKETS


def _folders(path: str, name: str, runs: list[str]) -> list[str]:
    return [f"{path}/{name}/{run}" for run in runs]


def _live(spark: SparkSession, path: str, name: str, manifest: dict) -> DataFrame:
    about = manifest["tables"][name]
    schema = (
        StructType.fromJson(about["schema"])
        .add("version", LongType())
        .add("run", StringType())
        .add("bucket", IntegerType())
    )
    rows = (
        spark.read.schema(schema)
        .option("basePath", f"{path}/{name}")
        .parquet(*_folders(path, name, about["runs"]))
        .drop("run")
    )
    if about["replaced"]:
        # Small next to the table: an id per replaced episode. The join is left to Spark's measured sizes.
        replaced = (
            spark.read.schema("episode_id string, version bigint, run string")
            .option("basePath", f"{path}/_replaced")
            .parquet(*_folders(path, "_replaced", about["replaced"]))
            .groupBy(F.col("episode_id").alias("__id"))
            .agg(F.max("version").alias("__since"))
        )
        own = F.col("episode_id").cast("string") == F.col("__id")
        rows = rows.join(replaced, own & (F.col("version") < F.col("__since")), "left_anti")
    return rows.drop("version")


def read_table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A stored table as of its latest, or a former, version.

    Columns and folders come from the manifest, so no file is opened and no folder listed to learn them.
    """
    return _live(spark, path, name, _manifest(spark, path, version))


def of_episodes(df: DataFrame, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the episodes in ``ids`` (whose columns are all matched).

    On a stored table only the buckets of these episodes are read.  There are at most ``buckets``
    numbers to look up, however many ids.
    """
    return _in_buckets(df, _buckets_of(ids, buckets) if "bucket" in df.columns else []).join(
        ids, ids.columns, "left_semi"
    )


def _buckets_of(ids: DataFrame, buckets: int) -> list[int]:
    return [r.b for r in ids.select(bucket_of(F.col("episode_id"), buckets).alias("b")).distinct().collect()]


def _in_buckets(df: DataFrame, wanted: list[int]) -> DataFrame:
    return df.where(F.col("bucket").isin(wanted)) if "bucket" in df.columns else df


def _evolved(noted: dict | None, schema: StructType, name: str) -> StructType:
    """The noted columns, then new ones; a column keeps its type."""
    if noted is None:
        return schema
    old = StructType.fromJson(noted["schema"])
    for field in schema.fields:
        if field.name not in old.names:
            old = old.add(field)
        elif old[field.name].dataType.simpleString() != field.dataType.simpleString():
            raise ValueError(f"{name}.{field.name} is stored as {old[field.name].dataType.simpleString()}")
    return old


def _write(df: DataFrame, target: str, buckets: int) -> None:
    # Rebalancing cuts a bucket that holds a huge episode into several tasks and files.
    df = df.withColumn("bucket", bucket_of(F.col("episode_id"), buckets))
    _write_dealt(df.hint("rebalance", F.col("bucket")), target, buckets)


def _write_dealt(df: DataFrame, target: str, buckets: int) -> None:
    df = df.withColumn("bucket", bucket_of(F.col("episode_id"), buckets))
    order = [c for c in ("episode_id", "step") if c in df.columns]
    df.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(target)


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    if not publish(spark, f"{path}/_versions/{number}.json", json_text.dumps(manifest)):
        raise RuntimeError(f"the store got another version {number} meanwhile; write again: {path}")


def write_episodes(
    tables: Mapping[str, DataFrame],
    path: str,
    replace: bool = True,
    buckets: int = BUCKETS,
    dealt: Collection[str] = (),
) -> int:
    """Write the tables of a set of episodes; ids already stored are replaced, or refused.

    All tables change together, when the manifest of the new version appears; its number is returned. A table that is not given keeps
    its rows. Of two writers that start from the same version, the later one gets an error.

    ``dealt`` names tables whose tasks are even already, such as those of memory rows, which come out of a join by blocks
    of steps and are many times what is shuffled for it.  They are written by the tasks that make them, a file per task
    and bucket; :func:`compact` makes fewer of them.
    """
    episodes = tables["episodes"]
    spark = episodes.sparkSession
    if "created_at" not in episodes.columns:
        episodes = episodes.withColumn("created_at", F.current_timestamp())
    known = versions(spark, path)
    number = known[-1] + 1 if known else 1
    manifest = _manifest(spark, path) if known else {"buckets": buckets, "tables": {}}
    buckets = manifest["buckets"]
    run = f"version={number}/run={uuid.uuid4().hex}"
    replaced = False
    if known:
        stored = _live(spark, path, "episodes", manifest)
        incoming = episodes.select("episode_id").distinct()
        again = cut(of_episodes(stored.select("episode_id", "bucket"), incoming, buckets).distinct())
        clash = again.take(1)
        if clash and not replace:
            raise ValueError(f"episode already stored: {clash[0].episode_id}")
        replaced = bool(clash)
        if replaced:
            ids = again.select(F.col("episode_id").cast("string").alias("episode_id"))
            ids.write.parquet(f"{path}/_replaced/{run}")
    for name in TABLES:
        if name not in tables and name != "episodes":
            continue
        df = episodes if name == "episodes" else tables[name]
        about = manifest["tables"].get(name)
        schema = _evolved(about, df.schema, name)
        about = about or {"runs": [], "replaced": []}
        write = _write_dealt if name in dealt else _write
        write(df, f"{path}/{name}/{run}", buckets)
        manifest["tables"][name] = {
            "schema": schema.jsonValue(),
            "runs": [*about["runs"], run],
            "replaced": [*about["replaced"], run] if replaced else about["replaced"],
        }
    _commit(spark, path, number, manifest)
    return number


def compact(spark: SparkSession, path: str) -> int:
    """A version with the same rows, each table in one folder again and without replaced rows.

    Former versions stay readable; their files are left where they are.
    """
    number = versions(spark, path)[-1] + 1
    manifest = _manifest(spark, path)
    run = f"version={number}/run={uuid.uuid4().hex}"
    for name, about in list(manifest["tables"].items()):
        _write(_live(spark, path, name, manifest).drop("bucket"), f"{path}/{name}/{run}", manifest["buckets"])
        manifest["tables"][name] = {"schema": about["schema"], "runs": [run], "replaced": []}
    _commit(spark, path, number, manifest)
    return number


def list_episodes(episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Episodes with their number of steps, by creation time."""
    return (
        episodes.join(step_counts(steps), "episode_id", "left")
        .select(
            "episode_id",
            "scene_id",
            "environment",
            "created_at",
            F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        )
        .orderBy("created_at", "episode_id")
    )


def get_edges(
    edges: DataFrame,
    episodes,
    step: int | None = None,
    edge_type: str | None = None,
    target: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Edges of an episode, optionally of one step, type or target, in stored order.

    ``episodes`` is an id, or a table of ids (and steps) for many lookups at once.  On a stored
    table ids prune folders by their buckets and the other filters are pushed to the Parquet scan.
    """
    if isinstance(episodes, DataFrame):
        out = of_episodes(edges, episodes, buckets)
    else:
        out = edges.where(F.col("episode_id") == F.lit(episodes))
        if "bucket" in edges.columns:
            out = out.where(F.col("bucket") == bucket_of(F.lit(episodes), buckets))
    for name, value in (("step", step), ("edge_type", edge_type), ("target", target)):
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out.orderBy("episode_id", "step", "edge_type", "ord_major", "ord_minor")


def load_episode(
    tables: Mapping[str, DataFrame], ids: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Nested episodes rebuilt from the tables: rows of (episode, part) with ordered steps.

    ``ids`` selects episodes; one that is not stored is an error.  Of stored tables only the buckets
    of these episodes are read.
    """
    picked = {name: tables[name] for name in ("episodes", "steps", "step_objects", "edges")}
    if ids is not None:
        ids = ids.select("episode_id")
        asked = _buckets_of(ids, buckets)
        picked = {name: _in_buckets(df, asked) for name, df in picked.items()}
        unknown = ids.join(picked["episodes"], "episode_id", "left_anti").take(1)
        if unknown:
            raise KeyError(f"unknown episode_id: {unknown[0].episode_id}")
        # Objects and edges of steps that are not asked for are in no result. So they need not be picked one by one,
        # which would shuffle them once more, unless the ids are few.
        few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
        chosen = F.broadcast(ids) if few else ids
        for name in picked if few else ("episodes", "steps"):
            picked[name] = picked[name].join(chosen, "episode_id", "left_semi")
    return assemble_episodes(*picked.values())


def export_json(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON lines; their keys are most of the text, so they are packed unless ``compression`` says ``none``."""
    df.write.mode("overwrite").json(path, compression=compression)


def read_episode(
    spark: SparkSession, json: str | None = None, schema=None, tables=None, ids: DataFrame | None = None
) -> DataFrame:
    """Nested episodes from a JSON export, or from tables and ids."""
    if json is not None:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(json)
    if tables is not None and ids is not None:
        return load_episode(tables, ids)
    raise ValueError("give json, or both tables and ids")


def write_items(items: DataFrame, path: str) -> None:
    """Items as JSON lines under ``items`` and their count under ``manifest``."""
    # Counted while written; nothing is read again.
    written = Observation("items")
    counted = items.observe(written, F.count(F.lit(1)).alias("n_items"))
    counted.write.mode("overwrite").json(f"{path}/items")
    count = items.sparkSession.createDataFrame([(written.get["n_items"],)], "n_items bigint")
    count.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _digested(items: DataFrame) -> tuple[list, list[str]]:
    """Aggregates that tell sets of rows apart in any order: row count and sums of the parts of row hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(items.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(28,0)") for at in range(1, 65, 8)]
    sums = [F.sum(p).cast("string").alias(f"d{i}") for i, p in enumerate(parts)]
    return [F.count(F.lit(1)).alias("n_items"), *sums], [f"d{i}" for i in range(len(sums))]


def _digest(found: Mapping, names: list[str]) -> str:
    told = ":".join([str(found["n_items"]), *(found[n] or "0" for n in names)])
    return hashlib.sha256(told.encode()).hexdigest()


def freeze_items(items: DataFrame, path: str, version: str) -> str:
    """Write items as a version that never changes and return the digest of its rows.

    The rows lie in a folder named by their digest, which versions of equal rows share. Writing equal rows under a known
    version changes nothing; other rows are refused. The digest does not depend on the order of rows.
    """
    spark = items.sparkSession
    if not version or "/" in version:
        raise ValueError(f"not a name of a version: {version!r}")
    sums, names = _digested(items)
    seen = Observation("frozen")
    aside = f"{path}/_aside/{uuid.uuid4().hex}"
    items.observe(seen, *sums).write.parquet(aside)
    digest = _digest(seen.get, names)
    if not moved(spark, aside, f"{path}/rows/{digest}"):
        drop_aside(spark, aside)
    note = {"digest": digest, "n_items": seen.get["n_items"], "schema": items.schema.jsonValue()}
    if not publish(spark, f"{path}/versions/{version}.json", json_text.dumps(note)):
        held = json_text.loads(published(spark, f"{path}/versions/{version}.json"))["digest"]
        if held != digest:
            raise ValueError(f"version {version} holds other items: {held}")
    return digest


def frozen_items(spark: SparkSession, path: str, version: str, check: bool = False) -> DataFrame:
    """The items of a frozen version; ``check`` reads them all and compares their digest."""
    where = f"{path}/versions/{version}.json"
    if not exists(spark, where):
        raise FileNotFoundError(f"no such version: {where}")
    note = json_text.loads(published(spark, where))
    items = spark.read.schema(StructType.fromJson(note["schema"])).parquet(f"{path}/rows/{note['digest']}")
    if check:
        sums, names = _digested(items)
        if _digest(items.agg(*sums).first().asDict(), names) != note["digest"]:
            raise ValueError(f"the rows of version {version} have changed: {where}")
    return items
