"""Registered queries and their reference SQL, grouped by SURVEY section."""

from __future__ import annotations

import importlib
import traceback
import warnings

MODULES = ("relations", "texts", "documents", "streams", "models")
FAILED: dict[str, str] = {}  # groups that could not be imported, with the reason


def load():
    """Import every group and return (queries, reference SQL); a group that fails takes no other with it."""
    from registry.base import ORACLES, QUERIES
    for name in MODULES:
        try:
            importlib.import_module(f"registry.{name}")
        except Exception:
            FAILED[name] = traceback.format_exc()
            warnings.warn(f"queries of registry.{name} are missing:\n{FAILED[name]}", RuntimeWarning, stacklevel=2)
    return QUERIES, ORACLES
