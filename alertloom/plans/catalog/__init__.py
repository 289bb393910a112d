"""Runnable queries over the test tables, each with its SQL counterpart where there is one."""

from alertloom.plans.catalog.registry import ENTRIES, Entry

# Importing the modules registers their queries.
from alertloom.plans.catalog import (  # noqa: E402,F401
    cleaning,
    engineered,
    evaluation,
    labelling,
    logs,
    matrices,
    modelling,
    profiling,
    splitting,
    storage,
    vectorising,
)

__all__ = ["ENTRIES", "Entry"]
