"""Camera-frame geometry and relation labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roamframe.params import DEFAULTS, Params


def round_half_even(c: Column, digits: int) -> Column:
    """Scale, round halves to even, scale back; -0.0 becomes 0.0."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale + F.lit(0.0)


def fixed_digits(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def round_exact(c: Column, digits: int = 2) -> Column:
    """Round the exact binary value: 2.675 gives 2.67.

    Scaling is enough unless the scaled value is next to a tie, so the text route runs
    only there.
    """
    scaled = c * F.lit(float(10**digits))
    near_tie = F.abs(F.abs(scaled - F.floor(scaled)) - 0.5) < 1e-6
    by_text = fixed_digits(c, digits).cast("double")
    return F.when(near_tie, by_text).otherwise(round_half_even(c, digits)) + F.lit(0.0)


def xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def round_pose(p: Column, digits: int) -> Column:
    return xyz(*[round_half_even(p[a], digits) for a in "xyz"])


def camera_intrinsics(params: Params = DEFAULTS) -> dict[str, Column]:
    """Focal lengths, horizontal field of view and image centre; Catalyst folds the literals."""
    w, h = F.lit(float(params.image_width)), F.lit(float(params.image_height))
    half_v = F.radians(F.lit(float(params.fov_v)) / 2)
    half_h = F.atan(w / h * F.tan(half_v))
    return {
        "fx": w / (2 * F.tan(half_h)),
        "fy": h / (2 * F.tan(half_v)),
        "fov_h": F.degrees(2 * half_h),
        "cx": F.lit(params.image_width // 2),
        "cy": F.lit(params.image_height // 2),
    }


def world_to_local(cam: Column, pitch_deg: Column, yaw_deg: Column, pos: Column) -> Column:
    """World point in the camera frame (x right, y up, z ahead). Roll plays no part."""
    pitch, yaw = F.radians(pitch_deg), F.radians(yaw_deg)
    dx, dy, dz = (pos[a] - cam[a] for a in "xyz")
    ahead = F.sin(yaw) * dx + F.cos(yaw) * dz
    return xyz(
        F.cos(yaw) * dx - F.sin(yaw) * dz,
        F.cos(pitch) * dy + F.sin(pitch) * ahead,
        -F.sin(pitch) * dy + F.cos(pitch) * ahead,
    )


def project_pinhole(local: Column, params: Params = DEFAULTS) -> Column:
    """Pixel of a camera-frame point; null at or nearer than the minimum depth."""
    k = camera_intrinsics(params)
    return F.when(
        greater(local["z"], F.lit(params.min_depth)),
        F.struct(
            (k["fx"] * (local["x"] / local["z"]) + k["cx"]).alias("u"),
            (k["cy"] - k["fy"] * (local["y"] / local["z"])).alias("v"),
        ),
    )


def bearing_angles(local: Column) -> Column:
    return F.struct(
        F.degrees(F.atan2(local["x"], local["z"])).alias("alpha"),
        F.degrees(F.atan2(local["y"], local["z"])).alias("beta"),
    )


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def euclid_distance(a: Column, b: Column) -> Column:
    return norm(*[b[k] - a[k] for k in "xyz"])


# Spark orders NaN above every number; these compare it as false.
def greater(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & (a > b)


def distance_label(d: Column, params: Params = DEFAULTS) -> Column:
    return (
        F.when(d <= params.min_distance, "within reach")
        .when(d <= params.med_distance, "nearby")
        .when(d <= params.max_distance, "far")
        .otherwise("beyond")
    )


def x_direction_angle(angle: Column, threshold: float) -> Column:
    size = F.abs(angle)
    return (
        F.when((size < threshold) | greater(size, F.lit(180 - threshold)), "")
        .when(greater(angle, F.lit(0.0)), "right")
        .otherwise("left")
    )


def z_direction_angle(angle: Column, threshold: float) -> Column:
    size = F.abs(angle)
    return (
        F.when(size < 90 - threshold, "front")
        .when(greater(size, F.lit(90 + threshold)), "behind")
        .otherwise("")
    )


def _axis(v: Column, threshold: float, positive: str, negative: str) -> Column:
    return (
        F.when(greater(v, F.lit(threshold)), positive)
        .when(v < -threshold, negative)
        .otherwise("")
    )


def axis_direction_x(v: Column, threshold: float) -> Column:
    return _axis(v, threshold, "right", "left")


def axis_direction_y(v: Column, threshold: float) -> Column:
    return _axis(v, threshold, "above", "below")


def axis_direction_z(v: Column, threshold: float) -> Column:
    return _axis(v, threshold, "front", "behind")


def direction_triplet(
    diff: Column, params: Params = DEFAULTS, angle: Column | None = None
) -> Column:
    """(left/right by bearing, above/below by height, front/behind by depth sign).

    ``angle`` is the bearing in degrees where a column holds it already.
    """
    if angle is None:
        angle = F.degrees(F.atan2(diff["x"], diff["z"]))
    return F.struct(
        x_direction_angle(angle, params.angle_threshold).alias("x"),
        axis_direction_y(diff["y"], params.vertical_threshold).alias("y"),
        axis_direction_z(diff["z"], params.depth_threshold).alias("z"),
    )


def bbox_center(bbox: Column) -> Column:
    return F.struct(
        ((bbox["cmin"] + bbox["cmax"]) / 2.0).alias("x"),
        ((bbox["rmin"] + bbox["rmax"]) / 2.0).alias("y"),
    )


def bbox_center_pixel(bbox: Column) -> Column:
    return F.struct(
        F.floor((bbox["cmin"] + bbox["cmax"]) / 2).cast("int").alias("x"),
        F.floor((bbox["rmin"] + bbox["rmax"]) / 2).cast("int").alias("y"),
    )


def bbox_min_corner(corners: Column) -> Column:
    """Per-axis minimum over an array of corner points."""
    return xyz(*[F.array_min(corners[a]) for a in "xyz"])
