"""Imports every query module so the registry is complete."""

from . import q_community, q_denoise, q_distance, q_keys, q_model, q_occupancy, q_scenario, q_sources, q_taxonomy  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
