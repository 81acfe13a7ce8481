"""Calendar column expressions over a date column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The holiday list and the order of day names used in reports.
HOLIDAYS = (dt.date(2024, 4, 10), dt.date(2024, 6, 16))
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SEASONS = ("autumn", "spring", "summer", "winter")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_of_week(d: Column | str) -> Column:
    """Monday = 0."""
    return F.weekday(_c(d))


def is_weekend(d: Column | str) -> Column:
    return F.weekday(_c(d)).isin(5, 6).cast("int")


def is_holiday(d: Column | str, holidays: Sequence[dt.date] = HOLIDAYS) -> Column:
    return _c(d).isin(list(holidays)).cast("int") if holidays else F.lit(0)


def season(d: Column | str) -> Column:
    m = F.month(_c(d))
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer")
        .when(m.isin(9, 10, 11), "autumn")
    )


def season_flags(d: Column | str) -> dict[str, Column]:
    """One flag per season but the first in name order (the base level)."""
    s = season(d)
    return {f"season_{name}": (s == name).cast("int") for name in SEASONS[1:]}


def calendar_features(d: Column | str, holidays: Sequence[dt.date] = HOLIDAYS) -> dict[str, Column]:
    """Month, weekday, ISO week, quarter, weekend, holiday and season flags."""
    col = _c(d)
    return {
        "month": F.month(col),
        "dayofweek": day_of_week(col),
        "weekofyear": F.weekofyear(col),
        "quarter": F.quarter(col),
        "is_weekend": is_weekend(col),
        "is_holiday": is_holiday(col, holidays),
        **season_flags(col),
    }


def day_name(d: Column | str) -> Column:
    return F.date_format(_c(d), "EEEE")


def month_label(d: Column | str) -> Column:
    """``January 2024``."""
    return F.date_format(_c(d), "MMMM yyyy")


def bucket_end(d: Column | str, grain: str) -> Column:
    """Label of the calendar bucket: the day itself, or the last day of the bucket."""
    col = _c(d)
    if grain == "day":
        return col
    if grain == "week":
        return F.date_add(F.trunc(col, "week"), 6)
    if grain == "month":
        return F.last_day(col)
    if grain == "quarter":
        return F.date_sub(F.add_months(F.trunc(col, "quarter"), 3), 1)
    if grain == "year":
        return F.make_date(F.year(col), F.lit(12), F.lit(31))
    raise ValueError(f"unknown grain: {grain}")


def bucket_step(start: Column, i: Column, grain: str) -> Column:
    """The label ``i`` buckets after the label ``start``."""
    if grain == "day":
        return F.date_add(start, i)
    if grain == "week":
        return F.date_add(start, i * 7)
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    return F.last_day(F.add_months(start, i * months))


def bucket_count(start: Column, end: Column, grain: str) -> Column:
    """How many buckets lie between two labels, counting both."""
    if grain in ("day", "week"):
        days = F.datediff(end, start)
        return (days / (7 if grain == "week" else 1)).cast("int") + 1
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return (months / {"month": 1, "quarter": 3, "year": 12}[grain]).cast("int") + 1
