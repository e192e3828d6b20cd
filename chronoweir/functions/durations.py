"""Durations such as 7d or 1h30m."""

from __future__ import annotations

import re

_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_PART = re.compile(r"(\d+)(ns|us|ms|mo|s|m|h|d|w|q|y|i)")


def duration_micros(text: str) -> int:
    """Microseconds of a duration. Calendar units and positions have no fixed length and are rejected."""
    at, total = 0, 0
    for m in _PART.finditer(text):
        if m.start() != at:
            break
        at, n, unit = m.end(), int(m[1]), m[2]
        if unit in ("mo", "q", "y", "i"):
            raise ValueError(f"duration unit '{unit}' has no fixed length")
        total += n // 1000 if unit == "ns" else n * _MICROS[unit]
    if at != len(text) or total <= 0:
        raise ValueError(f"not a positive duration: '{text}'")
    return total
