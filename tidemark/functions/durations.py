"""Durations as text, numbers of seconds, or timedeltas."""

from __future__ import annotations

from datetime import timedelta

# The unit names of the duration grammar, in microseconds.
UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def parse_duration(value: str | int | float | timedelta) -> timedelta:
    """``"1.5h"``, ``90`` (seconds) or a timedelta.  Text has one unsigned number and one unit; ``m`` is minutes."""
    match value:
        case timedelta():
            return value
        case str():
            text = value.strip()
            unit = max((u for u in UNITS if text.endswith(u)), key=len, default="")
            whole, point, part = text.removesuffix(unit).partition(".")
            if unit and whole.isdecimal() and (part.isdecimal() or not point):
                return timedelta(microseconds=float(f"{whole}.{part or 0}") * UNITS[unit])
            raise ValueError(f"not a duration: {value!r}")
        case _:
            return timedelta(seconds=value)


def micros(value: str | int | float | timedelta) -> int:
    return parse_duration(value) // timedelta(microseconds=1)


def interval(value: str | int | float | timedelta) -> str:
    """As a Spark interval string."""
    return f"{micros(value)} microseconds"
