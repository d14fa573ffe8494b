"""Instants as milliseconds since 1970 in UTC, and their RFC 3339 spelling."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from ..errors import EngineError

RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:[Zz]|([+-])(\d\d):(\d\d))", re.ASCII)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MILLISECOND = timedelta(milliseconds=1)
LEAST = (datetime(1, 1, 1, tzinfo=timezone.utc) - EPOCH) // MILLISECOND
MOST = (datetime(9999, 12, 31, 23, 59, 59, 999000, tzinfo=timezone.utc) - EPOCH) // MILLISECOND


def parse_instant(text: str) -> int | None:
    """Milliseconds of an RFC 3339 time with an offset; None if it is none, or is finer than a millisecond."""
    m = RFC3339.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute, second = map(int, m.groups()[:6])
    part = m[7] or ""
    if part[3:].strip("0"):
        return None
    offset = 0
    if m[8]:
        if int(m[9]) > 23 or int(m[10]) > 59:
            return None
        offset = (int(m[9]) * 60 + int(m[10])) * (1 if m[8] == "+" else -1)
    try:
        at = datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)
    except ValueError:
        return None
    ms = (at - EPOCH) // MILLISECOND + int((part + "000")[:3]) - offset * 60_000
    return ms if LEAST <= ms <= MOST else None


def spell_instant(ms: int) -> str:
    at = EPOCH + timedelta(milliseconds=ms)
    return at.strftime("%Y-%m-%dT%H:%M:%S.").rjust(20, "0") + f"{ms % 1000:03d}Z"


def instant_of(value: datetime | int | str) -> int:
    """Milliseconds of a time given in Python; a naive time is in UTC."""
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        ms = parse_instant(value)
        if ms is None:
            raise EngineError("INVALID_REQUEST", f"not a time: {value}")
        return ms
    value = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value
    return (value - EPOCH) // MILLISECOND
