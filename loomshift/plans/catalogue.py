"""Imports every module that registers queries."""

from loomshift.plans import agentlog, corpus, hive, logs, runstate, streams  # noqa: F401
from loomshift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
