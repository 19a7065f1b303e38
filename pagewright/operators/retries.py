"""A stretch of a URL's fetch log as a map from retry state to retry state.

A success removes the pending task.  A failure opens one with retry count 0 or
adds one to its count; where the count reaches the limit of the failure's
category the task becomes permanent and the next failure opens a new one.

A stretch doesn't know the task that its first failure meets, but only that
task's retry count decides what happens, and it is below the largest limit.  So
the stretch is followed from every count (-1: no task) at once.  All starts
come together at the first success or where they have stopped; what the task
before the stretch brings along (its site, first failure, planned time) is left
open and filled in when the map is applied.
"""

from __future__ import annotations

import json

from ..functions import errors as E

#: fields of a task; ``own`` and ``planned_here`` say what the stretch knows itself
FIELDS = ("site", "first", "category", "message", "status", "last", "planned")
START = (None, None)


def planned_at(at: int, count: int, low: float, high: float, backoff: E.Backoff = E.Backoff()) -> int:
    """Time of the next try (microseconds) after failure number ``count`` at ``at``."""
    delay = min((low + high) / 2.0 * backoff.factor ** count, backoff.cap)
    return at + round(delay * 1_000_000)


class Stretch:
    """Reads the fetches of a stretch in order; ``summary`` is its map.

    A pending task is (own, count, site, first, category, message, status,
    last, planned): ``own`` is false for a task from before the stretch, whose
    site and first failure are open, and ``last`` is null until the stretch has
    a failure of it.  A permanent task has ``planned_here`` in front of
    ``planned``.
    """

    def __init__(self, most: int, backoff: E.Backoff = E.Backoff()):
        self.backoff = backoff
        self.live = {(None, None): [-1]}
        self.live |= {((False, n, *[None] * 7), None): [n] for n in range(most)}

    def _after(self, state: tuple, fetch: tuple) -> tuple:
        pending, permanent = state
        at, ok, site, status, category, message, limit, low, high = fetch
        if ok:
            return None, permanent
        count = pending[1] + 1 if pending else 0
        own, name, first = (pending[0], pending[2], pending[3]) if pending else (True, site, at)
        failure = category, message, status, at
        if count < limit:
            return (own, count, name, first, *failure, planned_at(at, count, low, high, self.backoff)), permanent
        known = pending is None or pending[7] is not None
        return None, (own, count, name, first, *failure, known, pending[8] if pending else None)

    def add(self, *fetch) -> None:
        """at, success, site, status, category, message, limit, low, high"""
        live: dict[tuple, list] = {}
        for state, starts in self.live.items():
            live.setdefault(self._after(state, fetch), []).extend(starts)
        self.live = live

    def summary(self) -> list:
        return [[sorted(starts), *state] for state, starts in self.live.items()]


def apply(summary: list, state: tuple) -> tuple:
    """(pending, permanent) after the stretch; a task is (count, *FIELDS)."""
    pending, permanent = state
    count = pending[0] if pending else -1
    after, stopped = next(x[1:] for x in summary if count in x[0])
    if stopped:
        own, n, site, first, *failure, known, planned = stopped
        if not own:
            site, first = pending[1], pending[2]
        permanent = (n, site, first, *failure, planned if known else pending[7])
    if after:
        own, n, site, first, *failure, planned = after
        if failure[3] is None:  # no failure here: the task is as it was
            return pending, permanent
        if not own:
            site, first = pending[1], pending[2]
        after = (n, site, first, *failure, planned)
    return after, permanent


def encode(summary: list) -> str:
    return json.dumps(summary)


def decode(text: str) -> list:
    return json.loads(text)
