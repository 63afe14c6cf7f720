"""Spark-native news-intelligence analytics.

Severity and monitoring labels produced here are machine-generated analytic
indicators, not official assessments. The names below are imported when they
are first used, so that workers load only what they need.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"
_EXPORTS = {
    "Desk": "tidewire.plans.desk",
    "Engine": "tidewire.sources.engine",
    "Pipeline": "tidewire.plans.stages",
    "REGISTRY": "tidewire.sources.engine",
    "Registry": "tidewire.sources.engine",
    "Source": "tidewire.sources.engine",
    "TextIndex": "tidewire.operators.index",
    "article_stages": "tidewire.plans.stages",
    "remove_intermediates": "tidewire.storage",
}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
