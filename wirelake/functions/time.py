"""Time expressions: recordings count nanoseconds from their start."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import col


def seconds(ns="timestamp_ns") -> Column:
    return col(ns) / 1e9


def event_time(start_ns="start_ns", ns="timestamp_ns") -> Column:
    """Whole microseconds; NULL where the start is unknown (0)."""
    micros = F.timestamp_micros(F.call_function("div", col(start_ns) + col(ns), F.lit(1000)))
    return F.when(col(start_ns) != 0, micros)


def iso_ns(ns) -> Column:
    """ISO-8601 with nine digits, UTC."""
    n = col(ns)
    whole = F.call_function("div", n, F.lit(1_000_000_000))
    return F.concat(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(n, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


_LAST = re.compile(r"last\s+([0-9.]+)\s*(sec|min)", re.I)
_BETWEEN = re.compile(r"([0-9]+(?:\.[0-9]+)?)\s*s(?:ec(?:ond)?s?)?\s+(?:to|and|-|--)\s+([0-9]+(?:\.[0-9]+)?)\s*s", re.I)
_CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(?:to|-|--)\s*(\d{1,2}):(\d{2})(?::(\d{2}))?")


def parse_time_range(text: str, t_min: float, t_max: float, t0_seconds_of_day: float | None = None) -> tuple[float, float] | None:
    """"last 30 sec", "50s to 100s" (from the recording's start) and "10:00 to
    10:05:30" (wall clock, where its start is known) within the recording's
    bounds; None where the text names no range."""
    if m := _LAST.search(text):
        return max(t_min, t_max - float(m[1]) * (60.0 if m[2].lower() == "min" else 1.0)), t_max
    if m := _BETWEEN.search(text):
        ends = float(m[1]), float(m[2])
    elif (m := _CLOCK.search(text)) and t0_seconds_of_day is not None:
        ends = tuple(int(m[i]) * 3600 + int(m[i + 1]) * 60 + int(m[i + 2] or 0) - t0_seconds_of_day for i in (1, 4))
    else:
        return None
    return max(t_min, t_min + ends[0]), min(t_max, t_min + ends[1])


def axis_marks(t_min: float, t_max: float, most: int = 10) -> list[tuple[float, str]]:
    """Round positions for a time axis with their labels."""
    span = max(t_max - t_min, 1e-9)
    raw = span / most
    power = 10 ** math.floor(math.log10(raw))
    step = next(f * power for f in (1, 2, 5, 10) if f * power >= raw)
    first = math.ceil(t_min / step) * step
    return [(x := round(first + i * step, 9), f"{x:g}s" if span < 120 else f"{int(x // 60)}:{x % 60:04.1f}") for i in range(int((t_max - first) / step + 1e-9) + 1)]
