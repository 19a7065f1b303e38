"""A stretch of a domain's request log as a map from start state to end state.

Replaying requests in order is sequential: each result changes the delay, the
failure run and the block that the next one meets.  Here a stretch of the log
is read once, without knowing the state before it, and summarised as the map
that it applies to any state.  Stretches can so be read in parallel, in any
order, and their maps applied one after the other; the result is the replay's,
bit for bit.

* **Delay.**  A success multiplies a positive delay by 0.8 down to a floor, a
  failure doubles it up to a ceiling.  Both are monotone, so a stretch is
  followed from a start below and from one above all delays.  Where the two
  ends meet, every start ends there.  Where they don't, a start between them
  either met one of them (it was clamped, and ends where that one ends) or was
  never clamped: its end is the middle one of the two ends and the unclamped
  value, 2^failures times the start multiplied ``successes`` times by 0.8.
  Doubling is exact, so the order of the two doesn't matter.  A delay that is
  not positive yet becomes the configured one with the first failure.
* **Failure run and block.**  Not blocked, the run has 0 to 4 failures: five
  starts.  Blocked until some time, it has 0 to 3, or 4 and more, of which the
  next failure extends the block whatever the number: five starts with an end
  of the block that never comes.  Until such a start meets a failure that sets
  a new end, the old end can come at any event; the ends after that are kept
  with the latest time of the old end that leads there.  They change within
  the last failure run only, as a success makes all of them alike.
"""

from __future__ import annotations

import json
import math

# Pacing defaults of the rate limiter class.
MIN_DOMAIN_DELAY, MAX_DOMAIN_DELAY = 1.0, 20.0
FAILURE_BACKOFF, SUCCESS_RECOVERY = 2.0, 0.8
MAX_FAILURES_BEFORE_THROTTLE, THROTTLE_MINUTES = 5, 5
DOUBLE_FAILURE_STATUSES = (403, 429, 503)

_BLOCK = THROTTLE_MINUTES * 60 * 1_000_000
_NEVER = 1 << 62  # an end of a block that no event reaches
_MANY = 1 << 40   # stands for a start with four failures or more
_TOP = MAX_FAILURES_BEFORE_THROTTLE - 1
START = (0.0, 0, None)


def delay_after(delay: float, ok: bool, base: float) -> float:
    if ok:
        return max(MIN_DOMAIN_DELAY, delay * SUCCESS_RECOVERY) if delay > 0 else delay
    return base if delay <= 0 else min(MAX_DOMAIN_DELAY, delay * FAILURE_BACKOFF)


def run_after(run: tuple, at: int, ok: bool, double: bool) -> tuple:
    """(failures, block's end or None) after one request at ``at`` (microseconds)."""
    failures, until = run
    if until is not None and at >= until:
        failures, until = 0, None
    for good in (ok, False) if double else (ok,):
        failures = 0 if good else failures + 1
        if failures >= MAX_FAILURES_BEFORE_THROTTLE:
            until = at + _BLOCK
    return failures, until


class Stretch:
    """Reads the requests of a stretch in order; ``summary`` is its map."""

    def __init__(self):
        self.ups = self.downs = self.requests = self.successes = 0
        self.zero, self.low, self.high = 0.0, 1e-300, 1e300
        self.first = self.last = None
        # distinct states, each with the starts that have come to it
        self.live = {(f, None): [("free", f)] for f in range(_TOP + 1)}
        self.live |= {(f, _NEVER): [("held", f)] for f in range(_TOP)} | {(_MANY, _NEVER): [("held", _TOP)]}
        self.expired: list[list] = []  # [latest old end, state]: what an old end of the block leads to
        self.tables: dict[int, list] = {}

    def add(self, at: int, ok: bool, double: bool, base: float) -> None:
        if self.first is None:
            self.first = at
        elif len(self.tables) <= _TOP:
            if self.expired and self.expired[-1][1] == (0, None):
                self.expired[-1][0] = at
            else:
                self.expired.append([at, (0, None)])
        self.last = at
        live: dict[tuple, list] = {}
        for run, starts in self.live.items():
            live.setdefault(run_after(run, at, ok, double), []).extend(starts)
        self.live = live
        if len(self.tables) <= _TOP:
            self._follow_expired(at, ok, double)
        for good in (ok, False) if double else (ok,):
            self.requests += 1
            self.successes += good
            self.downs += good
            self.ups += not good
            self.zero = delay_after(self.zero, good, base)
            self.low = delay_after(self.low, good, base)
            self.high = delay_after(self.high, good, base)

    def _follow_expired(self, at: int, ok: bool, double: bool) -> None:
        merged: list[list] = []
        for bound, run in self.expired:
            run = run_after(run, at, ok, double)
            if merged and merged[-1][1] == run:
                merged[-1][0] = bound
            else:
                merged.append([bound, run])
        self.expired = merged
        # starts whose block has got a new end no longer depend on the old one
        for run, starts in list(self.live.items()):
            if run[1] == _NEVER:
                continue
            for kind, f in [s[:2] for s in starts]:
                if kind == "held" and f not in self.tables:
                    self.tables[f] = [[bound, ("after", f, i)] for i, (bound, _) in enumerate(self.expired)]
                    for i, (_, r) in enumerate(self.expired):
                        self.live.setdefault(r, []).append(("after", f, i))

    def summary(self) -> dict:
        ends = {start: run for run, starts in self.live.items() for start in starts}
        return {
            "first": self.first, "requests": self.requests, "successes": self.successes,
            "ups": self.ups, "downs": self.downs, "zero": self.zero, "low": self.low, "high": self.high,
            "free": [ends["free", f] for f in range(_TOP + 1)],
            "held": [ends["held", f] for f in range(_TOP + 1)],
            "expired": [[[bound, *(ends[label] if f in self.tables else label)]
                         for bound, label in self.tables.get(f, self.expired)] for f in range(_TOP + 1)]}


def _unclamped(delay: float, ups: int, downs: int) -> float:
    """delay doubled ``ups`` times and multiplied ``downs`` times by 0.8, rounded
    at every step as the replay does, in a range that no step leaves."""
    part, power = math.frexp(delay)
    for _ in range(downs):
        part *= SUCCESS_RECOVERY
        if part < 0.5:
            part *= 2
            power -= 1
    power += ups
    return math.inf if power > 1000 else 0.0 if power < -1000 else math.ldexp(part, power)


def apply(summary: dict, state: tuple) -> tuple:
    """End state (delay, failures, block's end) of a stretch from a start state."""
    delay, failures, until = state
    if delay <= 0:
        delay = summary["zero"] if summary["ups"] else delay
    elif summary["low"] == summary["high"]:
        delay = summary["low"]
    else:
        delay = min(summary["high"], max(summary["low"], _unclamped(delay, summary["ups"], summary["downs"])))
    if until is not None and until <= summary["first"]:
        failures, until = 0, None
    if until is None:
        return (delay, *summary["free"][failures])
    for bound, f, end in summary["expired"][min(failures, _TOP)]:
        if until <= bound:
            return delay, f, end
    f, end = summary["held"][min(failures, _TOP)]
    return delay, failures + f - _MANY if f >= _MANY else f, until if end == _NEVER else end


def encode(summary: dict) -> str:
    return json.dumps(summary)


def decode(text: str) -> dict:
    return json.loads(text)
