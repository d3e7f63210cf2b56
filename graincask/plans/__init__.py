"""Queries of the engine; importing this package registers them."""

from graincask.plans import agents, curation, reports, retrieval, streams  # noqa: F401
