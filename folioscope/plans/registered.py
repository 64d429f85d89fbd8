"""All registered queries over the test tables, and their SQL: importing the modules that have them registers them."""

from __future__ import annotations

from folioscope.plans import core, evaluations, indexes, records
from folioscope.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "core", "evaluations", "indexes", "records"]
