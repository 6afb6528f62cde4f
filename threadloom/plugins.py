"""Plugins: functions that are given the engine and add to it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from importlib.metadata import entry_points


def load(engine, group: str = "threadloom.plugins", found: Iterable | None = None) -> dict[str, Exception | None]:
    """Calls each plugin of ``group`` with ``engine``; the error of each, or None. A broken one stops neither the engine nor the others.

    ``found`` takes the place of the installed entry points: objects with ``name`` and ``load()``.
    """
    out: dict[str, Exception | None] = {}
    for point in sorted(entry_points(group=group) if found is None else found, key=lambda p: p.name):
        try:
            register: Callable = point.load()
            register(engine)
            out[point.name] = None
        except Exception as e:  # noqa: BLE001  whatever a plugin does wrong is its own
            out[point.name] = e
    return out
