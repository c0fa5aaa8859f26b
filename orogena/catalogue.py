"""Every query on the map operators with its oracle SQL, by name."""

from __future__ import annotations

from orogena.plans import files, linkage, places, regions, rewriting, surfaces
from orogena.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _plans in (places, regions, linkage, rewriting, files, surfaces):
    QUERIES |= _plans.R.queries
    ORACLES |= _plans.R.oracles
