"""Change-point tracks and as-of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.operators.poses import catalog_keys
from roamframe.ordered import BLOCK, last_value, previous, step_block, with_ordered
from roamframe.storage import cut

POSE = ["pos_x", "pos_y", "pos_z", "rot_x", "rot_y", "rot_z"]
STATE_KEYS = [
    "visible",
    "in_camera_fov",
    "parent_receptacle",
    "is_inside_receptacle",
    "receptacle_is_open",
]


def change_points_exact(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str],
    strict: Sequence[str] = (),
    block: Column | None = None,
) -> DataFrame:
    """First row of each part and rows whose key fields differ from the row before.

    A missing value equals a missing value, except in ``strict`` columns, where it equals nothing.
    """
    marked = df.withColumn("__now", F.struct(*keys))
    marked = with_ordered(
        marked,
        part,
        order,
        step_block(order[0]) if block is None else block,
        {"__before": previous("__now")},
    )
    same = F.col("__before").isNotNull()
    for k in keys:
        now, before = F.col(f"__now.{k}"), F.col(f"__before.{k}")
        equal = F.coalesce(now == before, F.lit(False)) if k in strict else now.eqNullSafe(before)
        same = same & equal
    return marked.where(~same).select(*df.columns)


def passage_change_points(
    passage_state: DataFrame, order: Sequence[str] = ("timestep",), block: Column | None = None
) -> DataFrame:
    return change_points_exact(
        passage_state,
        ["episode_id", "passage_id"],
        list(order),
        ["is_open", "is_locked", "from_region", "to_region"],
        block=block,
    )


def region_change_points(
    trajectory: DataFrame, order: Sequence[str] = ("timestep",), block: Column | None = None
) -> DataFrame:
    """Region changes; a missing region id counts as a change every time."""
    return change_points_exact(
        trajectory,
        ["episode_id"],
        list(order),
        ["region_id", "region_type"],
        strict=["region_id"],
        block=block,
    )


def _differs(a: Column, b: Column, pose_cols, keys, eps: float) -> Column:
    out = F.lit(False)
    for c in pose_cols:
        gap = F.abs(a[c] - b[c])
        out = out | F.coalesce(~F.isnan(gap) & (gap > eps), F.lit(False))
    for k in keys:
        out = out | ~a[k].eqNullSafe(b[k])
    return out


def change_points_eps(
    df: DataFrame,
    part: Sequence[str],
    ord_col: str,
    pose_cols: Sequence[str],
    keys: Sequence[str],
    eps: float = 1e-4,
    block_size: int = BLOCK,
) -> DataFrame:
    """First row of each part and rows that differ from the last *kept* row.

    A pose differs when a coordinate moved by more than ``eps``, so slow drift adds up; a NaN
    coordinate never counts as moved.  Rows equal to the row before them cannot be kept and go
    first.  The rest is folded in blocks of at most ``block_size`` steps.  Blocks whose part has an
    earlier one are folded again from the last row that it keeps, and again while that row changes;
    by induction over the blocks that is the sequential result.
    """
    part = list(part)
    compared = [*pose_cols, *keys]
    rest = [c for c in df.columns if c not in part]
    marked = with_ordered(
        df.withColumn("__now", F.struct(*compared)),
        part,
        [ord_col],
        step_block(ord_col),
        {"__before": previous("__now")},
    )
    # The wrapped comparison treats NaN as equal to NaN and null as equal to null.
    moving = marked.where(~F.col("__before").eqNullSafe(F.col("__now")))
    blocks = cut(
        moving.withColumn("__blk", step_block(ord_col, block_size))
        .groupBy(*part, "__blk")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(ord_col, *[c for c in rest if c != ord_col]))
            ).alias("rows")
        )
    )
    at = [*part, "__blk"]
    nothing = F.lit(None).cast(blocks.schema["rows"].dataType.elementType)

    def folded(df: DataFrame) -> DataFrame:
        """Blocks with ``start``: their last kept row and the places of all kept rows."""

        def step(acc: Column, place: Column) -> Column:
            row = F.get("rows", place)
            keep = acc["last"].isNull() | _differs(acc["last"], row, pose_cols, keys, eps)
            return F.struct(
                F.when(keep, row).otherwise(acc["last"]).alias("last"),
                F.when(keep, F.concat(acc["kept"], F.array(place)))
                .otherwise(acc["kept"])
                .alias("kept"),
            )

        places = F.sequence(F.lit(0), F.size("rows") - 1)
        first = F.struct(F.col("start").alias("last"), F.array().cast("array<int>").alias("kept"))
        return df.withColumn("__f", F.aggregate(places, first, step)).select(
            *at, "start", F.col("__f.last").alias("out"), F.col("__f.kept").alias("kept")
        )

    state = cut(folded(blocks.withColumn("start", nothing)))
    while True:
        carried = with_ordered(
            state.select(*at, F.col("start").alias("used"), "out"),
            part,
            ["__blk"],
            step_block("__blk"),
            {"start": previous("out")},
        )
        # Only blocks that were folded from another row than the one before them now keeps.
        again = cut(carried.where(~F.col("start").eqNullSafe(F.col("used"))).select(*at, "start"))
        if again.isEmpty():
            break
        settled = state.join(again, at, "left_anti")
        state = cut(settled.unionByName(folded(blocks.join(again, at))))
    chosen = state.select(*at, F.explode("kept").alias("__i"))
    rows = blocks.select(*at, F.posexplode("rows").alias("__i", "row"))
    return rows.join(chosen, [*at, "__i"], "left_semi").select(*part, "row.*").select(*df.columns)


def asof(
    rows: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    row_time: str,
    query_time: str,
    unique: bool = False,
) -> DataFrame:
    """Latest row at or before each query, null columns before the first.

    Rows and queries are merged and carried forward in order, so nothing depends on how many of
    them one key has.  Queries may ask for one point many times; ``unique`` says they do not, which
    saves reducing them to points and joining back.
    """
    keys = list(keys)
    values = [c for c in rows.columns if c not in keys]
    have = rows.select(
        *keys, F.col(row_time).alias("__t"), F.lit(0).alias("__q"), F.struct(*values).alias("__v")
    )
    ask = queries.select(*keys, F.col(query_time).alias("__t"))
    ask = (
        queries.select(*keys, F.col(query_time).alias("__t"), F.struct("*").alias("__row"))
        if unique
        else ask.distinct()
    )
    ask = ask.withColumns(
        {"__q": F.lit(1), "__v": F.lit(None).cast(have.schema["__v"].dataType)}
    )
    merged = have.unionByName(ask, allowMissingColumns=True)
    found = with_ordered(
        merged, keys, ["__t", "__q"], step_block("__t"), {"__hit": last_value("__v")}
    ).where(F.col("__q") == 1)
    if unique:
        answered = found.select("__row.*", "__hit")
    else:
        hits = found.select(*keys, F.col("__t").alias(query_time), "__hit")
        answered = queries.join(hits, [*keys, query_time])
    taken = {*queries.columns}
    return answered.select(
        *queries.columns,
        *[F.col(f"__hit.{v}").alias(v if v not in taken else f"at_{v}") for v in values],
    )


def asof_state(track: DataFrame, queries: DataFrame, unique: bool = False) -> DataFrame:
    """State of an object at a step: latest track entry with ``at_step <= step``."""
    return asof(track, queries, ["episode_id", "object_id"], "step", "step", unique)


def asof_series(
    rows: DataFrame,
    queries: DataFrame,
    keys: Sequence[str] = ("episode_id",),
    unique: bool = False,
) -> DataFrame:
    """The same on ``timestep`` rows (regions, passages)."""
    return asof(rows, queries, list(keys), "timestep", "step", unique)


def first_category(states: DataFrame, objects: DataFrame, ord_col: str = "step") -> DataFrame:
    """Category of the first state row per object, else the catalog type."""
    keys = catalog_keys(objects)
    first = states.groupBy("episode_id", "object_id").agg(
        F.min_by(F.struct("category"), ord_col).alias("__first")
    )
    catalog = objects.select(*keys, F.col("category").alias("__catalog"))
    return first.join(catalog, keys, "left").select(
        "episode_id",
        "object_id",
        F.when(F.col("__first").isNotNull(), F.col("__first.category"))
        .otherwise(F.col("__catalog"))
        .alias("category"),
    )


def object_state_track(states: DataFrame, objects: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Sparse states of displaced objects with their category."""
    kept = change_points_eps(
        states.select("episode_id", "object_id", "step", *POSE, *STATE_KEYS),
        ["episode_id", "object_id"],
        "step",
        POSE,
        STATE_KEYS,
        eps,
    )
    return kept.join(first_category(states, objects), ["episode_id", "object_id"])


def sort_states(states: DataFrame) -> DataFrame:
    return states.orderBy("episode_id", "step", "object_id")


def sort_passages(passage_state: DataFrame) -> DataFrame:
    return passage_state.orderBy("episode_id", "timestep", "passage_id")
