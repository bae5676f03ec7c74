"""Registered queries: each operator on the input tables, with the SQL that must agree."""

from recordflow.plans import (  # noqa: F401
    changes, checks, flows, owned_requests, reads, requests, rollups, texts, transfers)
from recordflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
