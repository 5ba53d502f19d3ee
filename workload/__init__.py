"""Registered queries over the provided tables, each with its SQL counterpart."""
from workload import catalog_queries, mode_queries, product_queries, signal_queries, spatial_queries, spectral_queries  # noqa: F401
from workload.registry import ORACLE, QUERIES  # noqa: F401
