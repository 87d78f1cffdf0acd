"""Queries over the given tables and their SQL twins."""

from vitaespark.workload import extracts, markup, pairs, quality, talks, texts, usage  # noqa: F401
from vitaespark.workload import flows  # noqa: F401  (reuses statements of the modules above)
from vitaespark.workload.registry import ORACLES, QUERIES  # noqa: F401
