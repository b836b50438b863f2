"""The set of canonical tables an analysis works on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from roamframe.operators.edges import edges_allocentric
from roamframe.operators.memory import memory_spans
from roamframe.operators.poses import visible_objects
from roamframe.operators.tracks import region_change_points
from roamframe.params import DEFAULTS, Params


@dataclass(frozen=True)
class EpisodeTables:
    """Logs of many episodes; ``episode_id`` leads every key, layouts are kept per scene."""

    episodes: DataFrame  # episode_id, scene_id, environment
    steps: DataFrame
    detections: DataFrame
    objects: DataFrame
    states: DataFrame  # displaced objects only
    events: DataFrame
    region_trajectory: DataFrame  # dense
    regions: DataFrame
    landmarks: DataFrame
    connectivity: DataFrame
    # Derived
    visible: DataFrame | None = None
    allocentric: DataFrame | None = None
    spans: DataFrame | None = None
    region_changes: DataFrame | None = None


def derive(
    t: EpisodeTables,
    params: Params = DEFAULTS,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> EpisodeTables:
    """Fill the derived tables; ``keep`` stores each one, as planners read them several times."""
    visible = keep(visible_objects(t.steps, t.detections, t.states, t.objects, params), "visible")
    return replace(
        t,
        visible=visible,
        allocentric=keep(edges_allocentric(visible, params), "allocentric"),
        spans=keep(memory_spans(t.steps, visible, t.states), "spans"),
        region_changes=keep(region_change_points(t.region_trajectory), "region_changes"),
    )
