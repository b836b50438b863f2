"""Small column and schema helpers shared by the text operators."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.storage import new_path

#: Rows of one Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 1000
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1_000_000


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Give the workers this package, once per application, and set how many rows a batch of texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.applicationId in _shipped:
        return
    from pyarrow import fs

    package = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    folder = new_path(spark, "package")
    files, place = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    files.create_dir(place, recursive=True)
    with files.open_output_stream(f"{place}/{package.name}.zip") as out:
        out.write(held.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/{package.name}.zip")
    _shipped.add(spark.sparkContext.applicationId)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(sizes, limit: int = STEP_BYTES):
    """Ranges of rows whose sizes add up to ``limit`` at most, or one larger row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
