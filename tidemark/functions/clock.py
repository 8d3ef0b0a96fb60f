"""Clocks that can be injected, so that tests decide what time it is."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Protocol

from .durations import parse_duration


class Clock(Protocol):
    def now(self) -> datetime: ...


class WallClock:
    def now(self) -> datetime:
        return datetime.now(timezone.utc)


class VirtualClock:
    def __init__(self, start: datetime = datetime(1970, 1, 1, tzinfo=timezone.utc)):
        self._now = start

    def now(self) -> datetime:
        return self._now

    def set(self, at: datetime) -> None:
        self._now = at

    def advance(self, by: str | float | timedelta) -> None:
        self._now += parse_duration(by)
