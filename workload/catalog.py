"""All registered queries."""

from workload import dumps, files, graph, retrieval, tables, trees  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
