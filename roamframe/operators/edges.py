"""Labelled relation edges."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamframe.functions import geometry as G
from roamframe.operators.poses import STEP, local_position, point
from roamframe.params import DEFAULTS, Params

EDGE_TYPES = ["egocentric", "allocentric", "object_frame", "inferred"]
# Objects that one array holds: those of a step, or of a cell of steps with more; a cell with more has several.
ARRAY_OBJECTS = 128
# Edge of a cell in search radii.
CELL_RADII = 4


def _edges(
    df: DataFrame,
    edge_type: str,
    order: tuple[Column, Column],
    ends: tuple[Column, Column],
    diff: Column,
    last_seen: Column,
    params: Params,
) -> DataFrame:
    """Edge rows along the offset ``diff``; distance and bearing are worked out once per row."""
    seen_now = edge_type != "inferred"
    offset = {f"__d{a}": diff[a] for a in "xyz"}
    d = G.xyz(*[F.col(c) for c in offset])
    measured = df.withColumns(offset).withColumns(
        {
            "distance": G.norm(*[F.col(c) for c in offset]),
            "__angle": F.degrees(F.atan2("__dx", "__dz")),
        }
    )
    relation = G.direction_triplet(d, params, F.col("__angle"))
    return measured.select(
        *STEP,
        F.lit(edge_type).alias("edge_type"),
        order[0].cast("bigint").alias("ord_major"),
        order[1].cast("bigint").alias("ord_minor"),
        ends[0].alias("source"),
        ends[1].alias("target"),
        G.round_exact(F.col("distance"), 2).alias("distance_metric"),
        G.distance_label(F.col("distance"), params).alias("distance_label"),
        F.lit(seen_now).alias("visible"),
        relation["x"].alias("angle_x"),
        relation["y"].alias("angle_y"),
        relation["z"].alias("angle_z"),
        F.lit(not seen_now).alias("inferred"),
        last_seen.cast("int").alias("last_seen"),
        "distance",
    )


def _from_agent(df: DataFrame, edge_type: str, major: str, minor: Column, last_seen: Column, params):
    return _edges(
        df,
        edge_type,
        (F.col(major), minor),
        (F.lit("agent"), F.col("object_id")),
        point("local"),
        last_seen,
        params,
    )


def edges_egocentric(visible: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Agent to every visible object: a projection."""
    return _from_agent(
        visible, "egocentric", "det_ord", F.lit(0), F.lit(None), params
    )


def knn_topk(candidates: Column, k: int) -> Column:
    """First ``k`` of an array of structs that start with distance and detection order."""
    return F.slice(F.array_sort(candidates), 1, k)


def _cell(x: Column, y: Column, z: Column) -> Column:
    """One number for a cell, 21 bits of each axis; cells that share one are only looked through together."""
    bits = [c.bitwiseAND(F.lit((1 << 21) - 1)) for c in (x, y, z)]
    return F.shiftleft(bits[0], 42).bitwiseOR(F.shiftleft(bits[1], 21)).bitwiseOR(bits[2])


def _cells(axes: list[str], size: float, reach: float) -> Column:
    """Cells that a point is at most ``reach`` away from along every axis: two per axis, often the same."""
    # A little more than the radius, so that rounding cannot hide a neighbour on the border.
    margin = reach * (1 + 1e-9) + 1e-9
    ends = [[F.floor((F.col(a) + F.lit(m)) / size) for m in (-margin, margin)] for a in axes]
    return F.array_distinct(F.array(*[_cell(*c) for c in product(*ends)]))


def _nearest_in_step(visible: DataFrame, params: Params, array_objects: int) -> DataFrame:
    """Nearest others of the same step.

    The objects are shuffled once, by their step.  A step of at most ``array_objects`` of them is one
    array, in which each looks at all others; steps with more are cut into cells.
    """
    axes = ["local_x", "local_y", "local_z"]
    place = ["object_id", "det_ord", *axes]
    # Without a place in space nothing is near; the comparison below would say so for each pair.
    for axis in axes:
        visible = visible.where(F.col(axis).isNotNull() & ~F.isnan(axis) & (F.abs(axis) < float("inf")))
    for key in STEP:
        visible = visible.where(F.col(key).isNotNull())
    step = Window.partitionBy(*STEP)
    counted = (
        visible.repartition(*STEP)
        .groupBy(*STEP, *place)
        # The place as it was given, as grouping turns -0.0 into 0.0.
        .agg(F.count(F.lit(1)).alias("__n"), *[F.first(a).alias(f"__{a}") for a in axes])
        .withColumn("__objects", F.sum("__n").over(step))
    )
    crowded = _nearest_in_cells(
        counted.where(F.col("__objects") > array_objects), params, array_objects
    )
    me = {c: F.col(c) for c in ("object_id", *axes)}
    other = F.struct("det_ord", "object_id", *[F.col(f"__{a}").alias(a) for a in axes], "__n")
    few = counted.where(F.col("__objects") <= array_objects)
    near = knn_topk(_within_radius("objs", me, params, "__n"), params.k_neighbors)
    # A repeated row of either end counts as often as it is there.
    repeated = F.flatten(F.transform(near, lambda m: F.array_repeat(m["o"], (m["n"] * F.col("__n")).cast("int"))))
    alone = few.withColumn("objs", F.collect_list(other).over(step)).where(F.size("objs") > 1)
    alone = alone.select(*STEP, *place, F.slice(repeated, 1, params.k_neighbors).alias("near"))
    return alone.unionByName(crowded).select(*STEP, *place, F.posexplode("near").alias("i", "n")).select(
        *STEP,
        *[F.col(c).alias(f"s_{c}") for c in ("object_id", "det_ord", *axes)],
        *[F.col(f"n.{c}").alias(f"n_{c}") for c in ("object_id", "det_ord", *axes)],
        F.col("n.dist").alias("dist"),
        (F.col("i") + 1).alias("rank"),
    )


def _within_radius(objs: str, me: dict[str, Column], params: Params, times: str | None = None) -> Column:
    """Others of an array that are near enough; with ``times`` as (o, n), n being how often each is there."""
    axes = ["local_x", "local_y", "local_z"]

    def measured(n: Column) -> Column:
        found = F.struct(
            G.norm(*[n[a] - me[a] for a in axes]).alias("dist"),
            n["det_ord"].alias("det_ord"),
            n["object_id"].alias("object_id"),
            *[n[a].alias(a) for a in axes],
        )
        return found if times is None else F.struct(found.alias("o"), n[times].alias("n"))

    one = (lambda m: m) if times is None else (lambda m: m["o"])
    return F.filter(
        F.transform(objs, measured),
        lambda m: (one(m)["object_id"] != me["object_id"]) & (one(m)["dist"] <= params.radius),
    )


def _nearest_in_cells(counted: DataFrame, params: Params, array_objects: int) -> DataFrame:
    """Nearest others in crowded steps, as arrays.

    A step is cut into cells of four search radii.  An object is written into every cell within the
    radius, two of them on average in a room, and looks through its own cell only: whatever is near
    enough has been written there.  A crowded cell is several arrays of bounded size, and what an
    object keeps of each is merged.  Work grows with the objects of a cell, not of the step, and rows
    per object are arrays, not pairs.
    """
    axes = ["local_x", "local_y", "local_z"]
    place = ["object_id", "det_ord", *axes]
    size = CELL_RADII * params.radius
    each = F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int")))
    visible = counted.withColumn("__copy", each).select(
        *STEP, "object_id", "det_ord", *[F.col(f"__{a}").alias(a) for a in axes]
    )
    slot = F.floor(F.col("det_ord") / F.lit(array_objects))
    frames = (
        visible.withColumn("__cell", F.explode(_cells(axes, size, params.radius)))
        .groupBy(*STEP, "__cell", slot.alias("__slot"))
        .agg(F.collect_list(F.struct("det_ord", "object_id", *axes)).alias("objs"))
    )
    own = _cell(*[F.floor(F.col(a) / size) for a in axes])
    looked = visible.select(*STEP, *place, own.alias("__cell")).join(frames, [*STEP, "__cell"])
    near = knn_topk(_within_radius("objs", {c: F.col(c) for c in place}, params), params.k_neighbors)
    kept = looked.select(*STEP, "__cell", *place, near.alias("near")).where(F.size("near") > 0)
    return kept.groupBy(*STEP, "__cell", *place).agg(
        knn_topk(F.flatten(F.collect_list("near")), params.k_neighbors).alias("near")
    ).drop("__cell")


def edges_allocentric(
    visible: DataFrame, params: Params = DEFAULTS, array_objects: int = ARRAY_OBJECTS
) -> DataFrame:
    """Each visible object to its nearest others of the same step, in the viewer's frame."""
    axes = ["local_x", "local_y", "local_z"]
    slim = visible.select(*STEP, "object_id", "det_ord", *axes)
    pairs = _nearest_in_step(slim, params, array_objects)
    return _edges(
        pairs,
        "allocentric",
        (F.col("s_det_ord"), F.col("rank")),
        (F.col("s_object_id"), F.col("n_object_id")),
        G.xyz(*[F.col(f"n_{a}") - F.col(f"s_{a}") for a in axes]),
        F.lit(None),
        params,
    )


def edges_inferred(non_visible: DataFrame, steps: DataFrame | None = None, params: Params = DEFAULTS):
    """Current pose to every remembered object out of view.

    Rows of :func:`roamframe.operators.memory.non_visible_objects` already carry the pose of their
    step; pass ``steps`` for rows that do not.
    """
    rows = non_visible
    if "cam_x" not in rows.columns:
        camera = steps.select(*STEP, "cam_x", "cam_y", "cam_z", "pitch_deg", "yaw_deg")
        rows = rows.join(camera, STEP)
    rows = rows.withColumn("__local", local_position(params)).withColumns(
        {f"local_{a}": G.round_half_even(F.col("__local")[a], 3) for a in "xyz"}
    )
    return _from_agent(
        rows, "inferred", "first_step", F.col("first_det_ord"), F.col("last_seen"), params
    )


def union_edges(*edges: DataFrame) -> DataFrame:
    """Edge lists are tagged by ``edge_type``; the object-frame list is always empty."""
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def edge_distances(edges: DataFrame) -> DataFrame:
    """Distances of egocentric and allocentric edges; inferred ones are left out."""
    return edges.where(F.col("edge_type").isin("egocentric", "allocentric")).select(
        "episode_id", "step", "edge_type", "distance"
    )


def first_ego_edge(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """First edge from the agent to the target, per (step, target) reference."""
    keys = [*STEP, "target"]
    return _first(
        edges.where((F.col("edge_type") == "egocentric") & (F.col("source") == "agent")), refs, keys
    )


def first_inferred_edge(edges: DataFrame, refs: DataFrame) -> DataFrame:
    return _first(edges.where(F.col("edge_type") == "inferred"), refs, [*STEP, "target"])


def first_allocentric_edge(edges: DataFrame) -> DataFrame:
    """First object-object edge per step."""
    between = edges.where(
        (F.col("edge_type") == "allocentric")
        & (F.col("source") != "agent")
        & (F.col("target") != "agent")
    )
    return _first(between, None, STEP)


def _first(edges: DataFrame, refs: DataFrame | None, keys: list[str]) -> DataFrame:
    rest = [c for c in edges.columns if c not in keys]
    if refs is not None:
        edges = edges.join(refs.select(*keys).distinct(), keys, "left_semi")
    return (
        edges.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct("ord_major", "ord_minor")).alias("__e"))
        .select(*keys, *[F.col("__e")[c].alias(c) for c in rest])
    )


def edges_of_visible(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges whose source and target are both visible at the step."""
    out = edges
    for end in ("source", "target"):
        seen = visible.select(*STEP, F.col("object_id").alias(end))
        out = out.join(seen, [*STEP, end], "left_semi")
    return out
