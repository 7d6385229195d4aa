"""All registered queries."""

from trialbook.plans import analysis, missions, storage, streams, texts  # noqa: F401
from trialbook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
