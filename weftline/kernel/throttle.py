"""Adaptive per-domain delays: one fold step for each request and response."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Throttle:
    start: float = 5.0
    most: float = 60.0
    concurrency: float = 1.0


@dataclass
class Slot:
    """The state of a domain: its delay, and when the next request may go."""

    delay: float
    next_allowed: float


def throttling(status: int) -> bool:
    return status in (429, 503)


def retry_after(text: str | None) -> float | None:
    """Seconds of a Retry-After header; dates and nonsense are None."""
    try:
        s = float((text or "").strip())
    except ValueError:
        return None
    return s if math.isfinite(s) and s >= 0 else None


def slot(t: Throttle, floor: float, now: float) -> Slot:
    return Slot(max(max(t.start, 0.0), floor), now)


def reserve(t: Throttle, s: Slot, floor: float, now: float) -> float:
    """How long the next request has to wait; it takes its place in the queue."""
    wait = max(0.0, s.next_allowed - now)
    s.next_allowed = max(s.next_allowed, now) + max(s.delay, floor)
    return wait


def record(t: Throttle, s: Slot, latency: float, status: int, after: float | None, floor: float, now: float) -> float:
    """The delay after a response: doubled on 429 and 503, else half way to latency / concurrency; only a 200 may lower it."""
    most = max(t.most, 0.0)
    if throttling(status):
        new = max(s.delay * 2, min(max(t.start, 1.0), most), after or 0.0)
    else:
        goal = max(latency, 0.0) / max(t.concurrency, 0.01)
        new = max((s.delay + goal) / 2, goal)
        if status != 200:
            new = max(s.delay, new)
    s.delay = min(max(new, min(floor, most)), most)
    if throttling(status):
        s.next_allowed = max(s.next_allowed, now + s.delay)
    return s.delay
