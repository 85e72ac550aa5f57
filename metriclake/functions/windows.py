"""Report windows, as plain dates: parameters of jobs, no data."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

MOST_DAYS = 3650


def report_window(zone: str, days: int, lag: int = 1, start: date | None = None, end: date | None = None, now: datetime | None = None) -> tuple[date, date]:
    """[start, end): as given, or the last `days` days that ended `lag` days ago in the site's zone."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    if start is None:
        today = (now or datetime.now(ZoneInfo("UTC"))).astimezone(ZoneInfo(zone)).date()
        end = today - timedelta(days=lag - 1)
        start = end - timedelta(days=days)
    if not 0 < (end - start).days <= MOST_DAYS:
        raise ValueError(f"a window has 1 to {MOST_DAYS} days")
    return start, end


def previous_window(start: date, end: date) -> tuple[date, date]:
    """The window of the same length that ends where this one starts."""
    return start - (end - start), start
