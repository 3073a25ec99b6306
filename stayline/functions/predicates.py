"""Predicates and scalar formulas on codes, stays, ages and outcomes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: seconds of a 365.25-day year.
YEAR_SECONDS = 31_557_600

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND


def col_named(name: str) -> Column:
    """Column by its literal name; generated names may hold dots and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def code_in_range(code: Column, low: int, high: int, digits: int = 3) -> Column:
    """The code starts with `digits` digits and their number lies in [low, high]."""
    number = F.substring(code, 1, digits).try_cast("int")
    return code.rlike(f"^[0-9]{{{digits}}}") & number.between(low, high)


def matches_any(text: Column, patterns: list[str]) -> Column:
    """The text matches at least one LIKE pattern, in any case."""
    return reduce(or_, [text.ilike(pattern) for pattern in patterns])


def equals_any_case(text: Column, value: str) -> Column:
    return F.upper(text) == value.upper()


def contains_any_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def micros_between(start: Column, end: Column) -> Column:
    """Elapsed microseconds.

    From the parts of the difference: `timestamp_diff` would read zone-less times in the
    session's zone and be an hour off across a clock change.
    """
    gap = end - start
    minutes = (_part("DAY", gap) * 24 + _part("HOUR", gap)) * 60 + _part("MINUTE", gap)
    return minutes * (60 * MICROS_PER_SECOND) + (_part("SECOND", gap) * MICROS_PER_SECOND).cast("long")


def _part(unit: str, gap: Column) -> Column:
    part = F.extract(F.lit(unit), gap)
    return part if unit == "SECOND" else part.cast("long")


def hour_number(time: Column) -> Column:
    """Whole hours since 1970: never decreasing with time."""
    gap = time - F.lit("1970-01-01").cast("timestamp_ntz")
    return _part("DAY", gap) * 24 + _part("HOUR", gap)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def lasts_at_most(start: Column, end: Column, hours: float) -> Column:
    """end - start is at most `hours`; an open stay (no end) does not qualify."""
    return micros_between(start, end) <= F.lit(int(hours * MICROS_PER_HOUR))


def age_in_years(birth: Column, at: Column) -> Column:
    return F.floor(micros_between(birth, at) / F.lit(float(YEAR_SECONDS * MICROS_PER_SECOND)))


def outcome_within_days(start: Column, event: Column, days: int) -> Column:
    """1 when the event happens at most `days` whole days after the start, also before it."""
    return F.when(_part("DAY", event - start) <= days, 1).otherwise(0)


def window_end(start: Column, hours: int) -> Column:
    return start + F.make_dt_interval(hours=F.lit(hours))


def in_window(time: Column, start: Column, hours: int) -> Column:
    """Both ends belong to the window."""
    return time.between(start, window_end(start, hours))


def cut_to_day(time: Column) -> Column:
    """Midnight of the day, without a detour through the session time zone."""
    return F.to_date(time).cast("timestamp_ntz")


def number_or_null(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(value), value)


def has_number(value: Column) -> Column:
    """Neither null nor NaN, written so that the null test reaches the scan."""
    return value.isNotNull() & ~F.isnan(value)
