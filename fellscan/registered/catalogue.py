"""Importing this module registers every query."""

from fellscan.registered import detect, scoring, spatial, terrain  # noqa: F401
from fellscan.registered.base import ORACLES, QUERIES  # noqa: F401
