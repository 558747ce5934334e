"""Time, calendar and holiday expressions. All are built-in columns; none needs a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadspan.config import STEP_MINUTES


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def floor_15min(ts: str | Column) -> Column:
    """Start of the 15-minute interval; keeps TIMESTAMP_NTZ."""
    return F.window(as_col(ts), f"{STEP_MINUTES} minutes").start


def floor_hour(ts: str | Column) -> Column:
    return F.window(as_col(ts), "1 hour").start


def floor_day(ts: str | Column) -> Column:
    return F.window(as_col(ts), "1 day").start


def steps_after(ts: str | Column, steps: int | Column, minutes: int | Column = STEP_MINUTES) -> Column:
    """Timestamp ``steps`` grid steps later (earlier when negative)."""
    count = steps if isinstance(steps, Column) else F.lit(steps)
    size = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return as_col(ts) + F.make_dt_interval(mins=(count * size).cast("int"))


def minutes_between(later: str | Column, earlier: str | Column) -> Column:
    """Minutes from one timestamp to another, through an interval so that no time zone enters."""
    seconds = (as_col(later) - as_col(earlier)).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / F.lit(60)


def calendar(ts: str | Column) -> dict[str, Column]:
    """hour, day_of_week (Monday = 0), month and the weekend flag."""
    ts = as_col(ts)
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": weekday,
        "month": F.month(ts),
        "is_weekend": (weekday >= 5).cast("int"),
        "is_holiday": us_holiday(ts).cast("int"),
    }


# US federal holidays with a fixed date (month, day, first year or None).
FIXED_HOLIDAYS = [
    (1, 1, None),
    (6, 19, 2021),
    (7, 4, None),
    (11, 11, None),
    (12, 25, None),
]

# US federal holidays on a weekday of a month
# (month, weekday with Monday = 0, first day of month it can fall on, first year or None).
FLOATING_HOLIDAYS = [
    (1, 0, 15, 1986),
    (2, 0, 15, None),
    (5, 0, 25, None),
    (9, 0, 1, None),
    (10, 0, 8, None),
    (11, 3, 22, None),
]


def _fixed_holiday(day: Column) -> Column:
    hit = F.lit(False)
    for month, dom, since in FIXED_HOLIDAYS:
        match = (F.month(day) == month) & (F.dayofmonth(day) == dom)
        if since is not None:
            match = match & (F.year(day) >= since)
        hit = hit | match
    return hit


def us_holiday(ts: str | Column) -> Column:
    """True on US federal holidays; fixed dates on a weekend are observed on the nearest workday."""
    day = F.to_date(as_col(ts))
    weekday = F.weekday(day)
    observed = (
        ((weekday <= 4) & _fixed_holiday(day))
        | ((weekday == 4) & _fixed_holiday(F.date_add(day, 1)))
        | ((weekday == 0) & _fixed_holiday(F.date_sub(day, 1)))
    )
    for month, dow, first, since in FLOATING_HOLIDAYS:
        match = (
            (F.month(day) == month)
            & (weekday == dow)
            & F.dayofmonth(day).between(first, first + 6)
        )
        if since is not None:
            match = match & (F.year(day) >= since)
        observed = observed | match
    return observed
