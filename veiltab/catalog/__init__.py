"""Registered queries and their SQL counterparts."""
from veiltab.catalog.registry import REGISTRY, load_all  # noqa: F401
