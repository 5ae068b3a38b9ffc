"""What several test modules use: dates and sorted rows."""

from __future__ import annotations

import datetime as dt


def weekdays(n: int, start: dt.date = dt.date(2024, 1, 1)) -> list[dt.date]:
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(1)
    return out


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
