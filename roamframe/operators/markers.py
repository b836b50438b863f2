"""Numbered markers of a frame as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.functions.clean import valid_bbox_marker
from roamframe.functions.colors import contrast_color, marker_color
from roamframe.functions.geometry import bbox_center_pixel
from roamframe.functions.text import legend_line, relation_text
from roamframe.operators.poses import BOX, STEP, bbox_fallback, dedup_last, point
from roamframe.ordered import row_number, step_block, with_ordered


def nav_bboxes(nav: DataFrame, ord_col: str = "det_ord") -> DataFrame:
    """Last drawable box per (step, object) of a navigation log."""
    drawable = nav.where(F.col("object_id").isNotNull()).withColumn(
        "__box", valid_bbox_marker(*[F.col(b) for b in BOX])
    )
    kept = drawable.where(F.col("__box").isNotNull()).select(
        *STEP, "object_id", ord_col, *[F.col(f"__box.{b}").alias(b) for b in BOX]
    )
    return dedup_last(kept, [*STEP, "object_id"], ord_col).drop(ord_col)


def marker_numbers(visible: DataFrame) -> DataFrame:
    """Markers 1..n over the objects of a step that have a place on the image.

    The place is the box centre, else the projected point.
    """
    # Each value gets its own column, so that none is worked out again inside the next.
    boxed = visible.withColumn("__box", valid_bbox_marker(*[F.col(b) for b in BOX]))
    boxed = boxed.withColumn("__centre", bbox_center_pixel(F.col("__box")))
    placed = (
        boxed.withColumns(
            {
                a: F.coalesce(F.col(f"__centre.{a}"), F.rint(f"px_{c}").cast("int"))
                for a, c in (("x", "u"), ("y", "v"))
            }
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .drop("__box", "__centre")
    )
    return with_ordered(
        placed, STEP, ["det_ord"], step_block("det_ord"), {"number": row_number()}
    )


def marker_table(
    visible: DataFrame,
    edges: DataFrame,
    nav: DataFrame | None = None,
    show_relations: bool = True,
    show_local_xyz: bool = False,
) -> DataFrame:
    """Marker number, place, colour and legend text per drawn object, with its frame's header."""
    boxed = visible if nav is None else bbox_fallback(visible, nav)
    numbered = marker_numbers(boxed)
    relations = edges.where(F.col("edge_type") == "egocentric").select(
        *STEP,
        F.col("target").alias("object_id"),
        relation_text(
            F.col("angle_x"), F.col("angle_y"), F.col("angle_z"), F.col("distance_label")
        ).alias("relation"),
    )
    sizes = visible.groupBy(*STEP).agg(F.count(F.lit(1)).alias("n_visible"))
    # Coloured before the joins, so that the colour is worked out once per marker.
    return (
        numbered.withColumn("color", marker_color(F.col("number") - 1))
        .join(relations, [*STEP, "object_id"], "left")
        .join(sizes, STEP)
        .select(
            *STEP,
            "number",
            "object_id",
            "x",
            "y",
            "color",
            contrast_color(F.col("color")).alias("text_color"),
            legend_line(
                F.col("number"),
                F.col("object_id"),
                F.coalesce("relation", F.lit("")),
                point("local"),
                show_relations,
                show_local_xyz,
            ).alias("legend"),
            F.concat(
                F.lit("step="),
                F.col("step").cast("string"),
                F.lit("  visible="),
                F.col("n_visible").cast("string"),
            ).alias("header"),
        )
    )
