"""Shared scratch space for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose tasks all run on this machine, gets a temporary folder;
    any other session must name one that its executors share.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="roamframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder that holds few of them; none if there is no such folder."""
    fs, where = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Give a finished file or folder its final name, unless that name is taken."""
    fs, where = _files(spark, source)
    to = _files(spark, target)[1]
    if fs.exists(to):
        return False
    fs.mkdirs(to.getParent())
    return fs.rename(where, to)


def drop_aside(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written aside and is not needed."""
    fs, where = _files(spark, path)
    fs.delete(where, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file that appears whole or not at all; False if the name is taken."""
    aside = f"{path}.{uuid.uuid4().hex}.aside"
    fs, where = _files(spark, aside)
    fs.mkdirs(where.getParent())
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    done = moved(spark, aside, path)
    if not done:
        drop_aside(spark, aside)
    return done


def published(spark: SparkSession, path: str) -> str:
    """The text of a file written by :func:`publish`."""
    return spark.read.option("wholetext", True).text(path).first()[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
