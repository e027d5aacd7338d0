"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

from timetide.jobs.registry import ORACLES, QUERIES

MODULES = ("analytics", "realtime", "calendars", "timetable", "rail", "merging", "matching", "sources", "streaming")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"timetide.jobs.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
