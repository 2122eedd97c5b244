"""All registered queries of the sequence library, by name."""

from __future__ import annotations

from . import core, extras, graphs, loaded, models, scheduled, structures, timelines

QUERIES: dict = {}
ORACLES: dict = {}
for part in (core, graphs, models, extras, timelines, structures, loaded, scheduled):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
