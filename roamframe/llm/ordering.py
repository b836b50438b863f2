"""A global order without a single task: range partitions, local ranks, one base per partition."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from roamframe.storage import saved


def _key_bytes(columns: list, row: int) -> bytes:
    """One value for the key of a row: the bytes themselves, or the packed integers."""
    values = [c[row].as_py() for c in columns]
    if len(values) == 1 and isinstance(values[0], bytes):
        return values[0]
    return struct.pack(f">{len(values)}q", *values)


def in_order(df: DataFrame, keys: list[str], ties: list[str], short: list[str] | None = None) -> DataFrame:
    """Sort all rows by ``keys`` then ``ties`` and number them.

    ``short`` are columns that follow from the keys and say almost as much, for keys that are long: rows
    are sorted and dealt by them first, so that the sample from which Spark takes the borders is small.
    They are dropped too.

    Adds ``name`` (dense rank of the keys, equal for equal keys) and ``place`` (row number), both from 0
    and without a gap, and drops the key columns. Keys are one binary column or long columns, not null.
    Ties spread a hot key over several range partitions; a key that crosses a border keeps one name, as
    every partition reports its first and last key. The rows pass through a table in the shared folder,
    so a lost executor cannot renumber what was read already.
    """
    spark = df.sparkSession
    short = short or []
    kept = [f for f in df.schema.fields if f.name not in [*keys, *short]]
    schema = StructType(
        [StructField(f.name, f.dataType) for f in kept]
        + [
            StructField("_part", IntegerType()),
            StructField("_rank", LongType()),
            StructField("_row", LongType()),
            StructField("_first", BinaryType()),
            StructField("_last", BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def number(batches):
        part = TaskContext.get().partitionId()
        rank, row, first, last = -1, 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            new = np.zeros(n, dtype=bool)
            for c in columns:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            head = _key_bytes(columns, 0)
            new[0] = head != last
            first = head if first is None else first
            last = _key_bytes(columns, n - 1)
            ranks = rank + np.cumsum(new)
            rows = row + np.arange(n)
            rank, row = int(ranks[-1]), row + n
            nothing = pa.nulls(n, pa.binary())
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(np.full(n, part, dtype=np.int32)), pa.array(ranks), pa.array(rows), nothing, nothing],
                schema=arrow,
            )
        if row:
            summary = {"_part": part, "_rank": rank + 1, "_row": row, "_first": first, "_last": last}
            yield pa.RecordBatch.from_pylist([summary], schema=arrow)

    dealt = df.repartitionByRange(*(short or keys), *ties).sortWithinPartitions(*short, *keys, *ties)
    numbered = saved(dealt.mapInArrow(number, schema), "ordered")
    # One summary row per partition: as many as the shuffle has partitions, whatever the input.
    by_part = Window.orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    up_to = by_part.rowsBetween(Window.unboundedPreceding, 0)
    bases = (
        numbered.filter(F.col("_first").isNotNull())
        .withColumn("_goes_on", F.coalesce(F.col("_first") == F.lag("_last").over(by_part), F.lit(False)).cast("long"))
        .select(
            "_part",
            (F.coalesce(F.sum("_rank").over(before), F.lit(0)) - F.sum("_goes_on").over(up_to)).alias("_name_base"),
            F.coalesce(F.sum("_row").over(before), F.lit(0)).alias("_row_base"),
        )
    )
    return (
        numbered.filter(F.col("_first").isNull())
        .join(F.broadcast(bases), "_part")
        .select(
            *[f.name for f in kept],
            (F.col("_name_base") + F.col("_rank")).alias("name"),
            (F.col("_row_base") + F.col("_row")).alias("place"),
        )
    )
