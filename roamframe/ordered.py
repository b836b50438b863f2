"""Ordered window functions that keep working when one key holds most of the rows.

A plain ``Window.partitionBy(episode_id)`` sorts a whole episode in one task.  Here the rows of a
key are cut into blocks (``block`` must grow with ``order``, usually ``step div BLOCK``):

1. every (key, block) is reduced to one summary row, with map-side combine;
2. the summaries of a key, a few thousand times fewer than its rows, carry values across blocks;
3. rows are windowed inside their block only and combined with the carried value.

No task ever holds more than one block of rows or the block summaries of one key.

By default the input is read for the summaries and again for the rows: the first reading is narrow and
summed up before its shuffle.  Where the input is costly, ``once`` deals the rows to their blocks first
and takes both from that one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
_BLK = BLOCK_COLUMN = "__block"
_ROWS = "__rows"


def step_block(col: str | Column, size: int = BLOCK) -> Column:
    """Block number of an integer ordinal."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(size))


@dataclass(frozen=True)
class Op:
    kind: str
    col: str | None = None


def row_number() -> Op:
    """1-based position within the key."""
    return Op("row_number")


def running_sum(col: str) -> Op:
    """Sum over this row and all earlier ones."""
    return Op("sum", col)


def total(col: str) -> Op:
    """Sum over all rows of the key."""
    return Op("total", col)


def last_value(col: str) -> Op:
    """Latest non-null value at or before this row."""
    return Op("last", col)


def first_value(col: str) -> Op:
    """Earliest non-null value at or before this row."""
    return Op("first", col)


def previous(col: str) -> Op:
    """Value of the row before, null on the first row."""
    return Op("previous", col)


def following(col: str) -> Op:
    """Value of the next row, null on the last row."""
    return Op("following", col)


def next_value(col: str) -> Op:
    """Earliest non-null value strictly after this row."""
    return Op("next", col)


def _summary(op: Op, order: Column) -> Column:
    if op.kind == "row_number":
        return F.count(F.lit(1))
    if op.kind in ("sum", "total"):
        return F.sum(op.col)
    if op.kind in ("previous", "following"):
        # Wrapped so that a null value is still carried as "the value of that row".
        pick = F.max_by if op.kind == "previous" else F.min_by
        return pick(F.struct(F.col(op.col).alias("v")), order)
    pick = F.max_by if op.kind == "last" else F.min_by
    return pick(F.col(op.col), F.when(F.col(op.col).isNotNull(), order))


def _carry(op: Op, name: str, keys: Sequence[str]) -> Column:
    up = Window.partitionBy(*keys).orderBy(_BLK)
    down = Window.partitionBy(*keys).orderBy(F.desc(_BLK))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    if op.kind in ("row_number", "sum"):
        return F.coalesce(F.sum(name).over(before), F.lit(0))
    if op.kind == "total":
        return F.sum(name).over(Window.partitionBy(*keys))
    if op.kind == "last":
        return F.last(name, ignorenulls=True).over(before)
    if op.kind == "first":
        return F.first(name, ignorenulls=True).over(before)
    if op.kind == "previous":
        return F.lag(name).over(up)
    if op.kind == "following":
        return F.lead(name).over(up)
    return F.last(name, ignorenulls=True).over(
        down.rowsBetween(Window.unboundedPreceding, -1)
    )


def _within(op: Op, carry: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    up = Window.partitionBy(*keys, _BLK).orderBy(*order)
    down = Window.partitionBy(*keys, _BLK).orderBy(*[F.desc(c) for c in order])
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(carry)
    if op.kind == "row_number":
        return (F.row_number().over(up) + c).cast("int")
    if op.kind == "sum":
        return F.coalesce(F.sum(op.col).over(so_far), F.lit(0)) + c
    if op.kind == "total":
        return c
    if op.kind == "last":
        return F.coalesce(F.last(op.col, ignorenulls=True).over(so_far), c)
    if op.kind == "first":
        return F.coalesce(c, F.first(op.col, ignorenulls=True).over(so_far))
    wrapped = F.struct(F.col(op.col).alias("v"))
    if op.kind == "previous":
        return F.coalesce(F.lag(wrapped).over(up), c)["v"]
    if op.kind == "following":
        return F.coalesce(F.lead(wrapped).over(up), c)["v"]
    after = down.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(op.col, ignorenulls=True).over(after), c)


def with_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    ops: Mapping[str, Op],
    once: bool = False,
    dealt: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add one column per entry of ``ops``; ``order`` must be unique within ``keys``.

    ``once`` reads the input a single time.  It needs every column of ``df`` to be used later on: a
    column dropped from one of the two readings would make them different shuffles.  Then ``dealt`` may choose
    among the rows of a block, which lie together by the keys and ``BLOCK_COLUMN``.
    """
    keys, order = list(keys), list(order)
    df = df.withColumn(_BLK, block)
    by = F.struct(*order)
    if once:
        # The join below drops null keys: said of both readings, lest their shuffles differ.
        for key in [*keys, _BLK]:
            df = df.where(F.col(key).isNotNull())
        df = df.repartition(*keys, _BLK)
        df = dealt(df) if dealt else df
    carries = {name: f"__carry_{i}" for i, name in enumerate(ops)}
    parts = [_summary(op, by).alias(carries[name]) for name, op in ops.items()]
    if once:
        # Counting whole rows keeps all columns in this reading, so that the shuffle is used again.
        parts.append(F.count(F.when(F.col(_BLK).isNotNull(), F.struct(*df.columns))).alias(_ROWS))
    summary = df.groupBy(*keys, _BLK).agg(*parts)
    if once:
        summary = summary.where(F.col(_ROWS) >= 0)
    summary = summary.select(
        *keys, _BLK, *[_carry(op, carries[n], keys).alias(carries[n]) for n, op in ops.items()]
    )
    joined = df.join(summary, [*keys, _BLK])
    kept = [c for c in df.columns if c != _BLK and c not in ops]
    return joined.select(
        *kept, *[_within(op, carries[n], keys, order).alias(n) for n, op in ops.items()]
    )
