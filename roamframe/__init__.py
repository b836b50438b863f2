"""Spark analytics over embodied-navigation episode logs."""

from roamframe.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
