"""Timeframes such as ``5m``: a count and a unit (minutes, hours, days, weeks, months)."""

from __future__ import annotations

import re
from dataclasses import dataclass

MINUTE = 60_000
#: A month is the fixed mean length.
UNITS = {"m": (MINUTE, "minute"), "h": (60 * MINUTE, "hour"), "d": (1440 * MINUTE, "day"), "w": (7 * 1440 * MINUTE, "week"), "M": (2_629_746_000, "month")}


@dataclass(frozen=True)
class Timeframe:
    id: str
    ms: int
    label: str


def parse(text: str) -> Timeframe:
    m = re.fullmatch(r"([0-9]+)([mhdwM])", text)
    if not m or int(m[1]) <= 0:
        raise ValueError(f"no timeframe: {text!r}")
    n, (ms, name) = int(m[1]), UNITS[m[2]]
    return Timeframe(text, n * ms, f"{n} {name}" + ("s" if n > 1 else ""))


def parse_or_minute(text: str) -> Timeframe:
    try:
        return parse(text)
    except ValueError:
        return parse("1m")
