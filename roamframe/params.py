"""Parameter record shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Camera
    image_width: int = 396
    image_height: int = 224
    fov_v: float = 59.0
    min_depth: float = 0.15
    # Relations
    angle_threshold: float = 15.0
    vertical_threshold: float = 0.1
    depth_threshold: float = 0.0
    min_distance: float = 0.5
    med_distance: float = 1.0
    max_distance: float = 1.5
    # Neighbours
    k_neighbors: int = 3
    radius: float = 1.5
    movement_constant: float = 0.2


DEFAULTS = Params()
