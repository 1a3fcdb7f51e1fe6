"""Stages of a run as named steps over named tables, put in an order in which each has what it needs."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple


class Stage(NamedTuple):
    """``run`` takes all tables so far and returns those that the stage provides."""

    name: str
    needs: tuple[str, ...]
    provides: tuple[str, ...]
    run: Callable[[dict], dict]


def ordered(stages: list[Stage], given: tuple[str, ...]) -> list[Stage]:
    """The stages so that every table is there before it is needed, otherwise as listed; ValueError if one never is, or in a circle."""
    left, have, out = list(stages), set(given), []
    while left:
        makers = {t for s in left for t in s.provides}
        ready = next((s for s in left if all(n in have and not (n in makers and n not in s.provides) for n in s.needs)), None)
        ready = ready or next((s for s in left if set(s.needs) <= have), None)
        if ready is None:
            raise ValueError("nothing provides " + ", ".join(sorted({n for s in left for n in s.needs} - have)))
        left.remove(ready)
        out.append(ready)
        have |= set(ready.provides)
    return out


def run(stages: list[Stage], tables: dict) -> dict:
    """All tables after every stage."""
    for stage in ordered(stages, tuple(tables)):
        tables = tables | stage.run(tables)
    return tables
