"""Registered queries and their SQL counterparts on the driver tables."""

from . import catalog  # noqa: F401
from . import alignment, cutpoints, fits, paths, preparation, readers, scores, traces  # noqa: F401


def queries():
    return {name: entry.run for name, entry in catalog.ENTRIES.items()}


def oracle_sql():
    return {name: e.sql() for name, e in catalog.ENTRIES.items() if e.body is not None}
