"""Times of variable precision as inclusive nanosecond ranges."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

_TIME = re.compile(
    r"\s*(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?)?)?)?"
    r"\s*(Z|[+-]\d{2}(?::?\d{2})?)?\s*(?:\[([\w/+\-]+)\])?\s*"
)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
NANO = 10**9


def _zone(offset: str | None, name: str | None):
    if name:
        return ZoneInfo(name)
    if offset and offset != "Z":
        digits = offset[1:].replace(":", "").ljust(4, "0")
        return timezone((1 if offset[0] == "+" else -1) * timedelta(hours=int(digits[:2]), minutes=int(digits[2:])))
    return timezone.utc


def _nanos(moment: datetime) -> int:
    gap = moment.astimezone(timezone.utc) - _EPOCH
    return (gap.days * 86400 + gap.seconds) * NANO


def time_range(text: str) -> tuple[int, int]:
    """(first, last) nanosecond of the year, month, day, hour, minute, second or fraction named; UTC by default."""
    m = _TIME.fullmatch(text)
    if not m:
        raise ValueError(f"not a time: {text!r}")
    year, month, day, hour, minute, second, fraction = m.groups()[:7]
    zone = _zone(m[8], m[9])
    start = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), tzinfo=zone)
    if fraction:
        step = 10 ** (9 - len(fraction))
        low = _nanos(start) + int(fraction) * step
        return low, low + step - 1
    if second or minute or hour:
        width = 1 if second else 60 if minute else 3600
        low = _nanos(start)
        return low, low + width * NANO - 1
    if day:
        after = (start.replace(tzinfo=None) + timedelta(days=1)).replace(tzinfo=zone)
    elif month:
        after = start.replace(year=start.year + (start.month == 12), month=start.month % 12 + 1)
    else:
        after = start.replace(year=start.year + 1)
    return _nanos(start), _nanos(after) - 1
