"""Queries over the driver's tables, each with its SQL twin.

The tables stand in for the engine's own: documents are raw releases (``doc_id`` is arrival order, ``source`` the
publisher), labels are processed releases, pages are page bodies and events are calendar change-log rows. Bodies for
the parse jobs are written from documents, one body per document with one item per line, so no group is gathered.
"""

from gazette.catalog import bodies, calendars, enrichment, rejects, releases, stored, streams  # noqa: F401
from gazette.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
