"""Predicates and clean-up of raw log columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.params import DEFAULTS, Params

# Object types that are part of the building, not spatial targets.
STRUCTURAL_TYPES = ["Wall", "Floor", "Ceiling", "Doorway", "Doorframe", "Room", "Window"]

# Construct, class, frame of reference, in the order used for numbering facts.
CONSTRUCTS = [
    ("egocentric_encoding", 1, "egocentric"),
    ("allocentric_encoding", 1, "allocentric"),
    ("spatial_working_memory", 2, "egocentric"),
    ("invisible_displacement", 2, "allocentric"),
    ("spatial_updating", 3, "egocentric"),
    ("perspective_taking", 3, "allocentric"),
    ("route_knowledge", 4, "egocentric"),
    ("survey_knowledge", 4, "allocentric"),
]
CONSTRUCT_NAMES = [name for name, _, _ in CONSTRUCTS]
STYLES = ("concise", "verbose")


def is_structural(type_: Column | None, id_: Column | None) -> Column:
    hit = F.lit(False)
    if type_ is not None:
        hit = hit | F.coalesce(type_.isin(STRUCTURAL_TYPES), F.lit(False))
    if id_ is not None:
        hit = hit | F.coalesce(id_.rlike(f"^({'|'.join(STRUCTURAL_TYPES)})\\|"), F.lit(False))
    return hit


def filter_structural(df: DataFrame, type_col: str | None, id_col: str | None) -> DataFrame:
    return df.where(
        ~is_structural(
            None if type_col is None else F.col(type_col),
            None if id_col is None else F.col(id_col),
        )
    )


def is_valid_id(id_: Column) -> Column:
    return id_.isNotNull() & ~F.lower(F.trim(id_)).isin("", "nan")


def filter_valid_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.where(is_valid_id(F.col(id_col)))


def parse_bool(c: Column, missing: bool | None = False) -> Column:
    """true / 1 / yes in any case; ``missing`` is what an absent value becomes."""
    return F.when(c.isNull(), F.lit(missing).cast("boolean")).otherwise(
        F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")
    )


def null_clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN becomes null, in number columns and in text columns that spell it."""
    types = dict(df.dtypes)
    out = {}
    for name in cols:
        c = F.col(name)
        if types[name] in ("double", "float"):
            out[name] = F.when(~F.isnan(c), c)
        else:
            out[name] = F.when(F.lower(F.trim(c.cast("string"))) != "nan", c)
    return df.withColumns(out)


def _finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def _pixel(c: Column) -> Column:
    return F.rint(c.cast("double"))


def _bbox(ok: Column, sides: tuple[Column, ...]) -> Column:
    names = ("cmin", "rmin", "cmax", "rmax")
    return F.when(
        ok, F.struct(*[_pixel(s).cast("int").alias(n) for n, s in zip(names, sides)])
    )


def valid_bbox_detect(cmin: Column, rmin: Column, cmax: Column, rmax: Column) -> Column:
    """Box of whole pixels (halves to even), null if any side is missing or not finite."""
    ok = _finite(cmin) & _finite(rmin) & _finite(cmax) & _finite(rmax)
    return _bbox(ok, (cmin, rmin, cmax, rmax))


def valid_bbox_marker(cmin: Column, rmin: Column, cmax: Column, rmax: Column) -> Column:
    """As :func:`valid_bbox_detect`, and the box must have positive width and height."""
    ok = _finite(cmin) & _finite(rmin) & _finite(cmax) & _finite(rmax)
    drawable = (_pixel(cmax) > _pixel(cmin)) & (_pixel(rmax) > _pixel(rmin))
    return _bbox(ok & drawable, (cmin, rmin, cmax, rmax))


def filter_steps(
    df: DataFrame, step: int | None = None, start: int | None = None, end: int | None = None
) -> DataFrame:
    """One step, or the inclusive range [start, end]."""
    if step is not None:
        return df.where(F.col("step") == step)
    if start is None and end is None:
        return df
    lo = 0 if start is None else start
    hi = lo if end is None else end
    if hi < lo:
        raise ValueError("end must not be before start")
    return df.where(F.col("step").between(lo, hi))


def is_action(action: Column) -> Column:
    return action.isNotNull() & ~F.lower(action).isin("", "nan", "none")


def filter_actions(steps: DataFrame) -> DataFrame:
    return steps.where(is_action(F.col("action")))


def is_movement(action: Column) -> Column:
    return F.coalesce(F.lower(action).rlike("move|rotate|turn|look"), F.lit(False))


def thresholds_block(params: Params = DEFAULTS) -> Column:
    def span(lo: float, hi: float) -> Column:
        return F.array(F.lit(float(lo)), F.lit(float(hi)))

    return F.struct(
        F.struct(
            span(0.0, params.min_distance).alias("within_reach"),
            span(params.min_distance, params.med_distance).alias("nearby"),
            span(params.med_distance, params.max_distance).alias("far"),
        ).alias("distance_label"),
        F.struct(
            F.lit(float(params.angle_threshold)).alias("lateral_deg"),
            F.lit(float(params.vertical_threshold)).alias("vertical_m"),
            F.lit(float(params.angle_threshold)).alias("depth_deg"),
        ).alias("relation"),
    )


def _names(value: str | Iterable[str]) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else list(value)
    return [p.strip() for p in parts if p.strip()]


def select_constructs(
    spark: SparkSession,
    names: str | Iterable[str] = CONSTRUCT_NAMES,
    styles: str | Iterable[str] = STYLES,
) -> DataFrame:
    """Chosen constructs x styles with class and frame; unknown constructs are skipped."""
    known = {name: (cls, frame) for name, cls, frame in CONSTRUCTS}
    rows = [
        (i, name, *known[name], style)
        for i, name in enumerate(n for n in _names(names) if n in known)
        for style in _names(styles)
    ]
    return spark.createDataFrame(
        rows, "construct_ord int, construct string, class int, frame_of_reference string, style string"
    )
