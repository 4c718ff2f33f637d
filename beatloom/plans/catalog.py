"""All registered queries."""

from beatloom.plans import catalog_charts, catalog_documents, catalog_sources, catalog_tracks  # noqa: F401
from beatloom.plans.registry import ORACLES, QUERIES, compose  # noqa: F401
