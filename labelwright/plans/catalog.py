"""Collects the registrations of every family."""

from labelwright.plans.registry import ORACLES, QUERIES  # noqa: F401
from labelwright.plans import queries_lines, queries_evidence, queries_lists, queries_rules, queries_rollup, queries_links, queries_pages, queries_sources, queries_streaming  # noqa: F401
