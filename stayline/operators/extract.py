"""Interval join: measurements that fall in a fixed window after a start time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named, cut_to_day, has_number, hour_number, in_window
from stayline.operators.joins import BROADCAST_BYTES, fits_broadcast, sized_join
from stayline.sources.bucketed import STRETCH

# Windows per key from which the time axis is cut into buckets.
CROWDED_KEY = 16


def window_extract(
    events: DataFrame,
    cohort: DataFrame,
    on: list[str],
    time: str,
    start: str,
    value: str,
    hours: int = 48,
    time_granularity: str | None = None,
    crowded_key: int = CROWDED_KEY,
    **join_options,
) -> DataFrame:
    """Events with a value, joined to the cohort rows with equal keys whose window holds them.

    The join is an equi-join; the window is a condition on the joined row, checked before
    anything is shuffled further. Cohort rows that share a key each get their own copy.
    `time_granularity="day"` cuts the event time to midnight first.

    If some key has many windows, comparing each of its events with each of them would grow
    with the product. Then time buckets as long as the window join the key: an event has one
    bucket and a window touches two, so only neighbours in time meet, once.
    The cohort is read several times: pass a stored one.
    """
    if time_granularity not in (None, "day"):
        raise ValueError(f"unsupported granularity: {time_granularity}")
    usable = events.filter(has_number(col_named(value)))
    if time_granularity == "day":
        usable = usable.withColumn(time, cut_to_day(col_named(time)))
    keys = list(on)
    if _most_windows(cohort, on) > crowded_key:
        first = _bucket(col_named(start), hours)
        usable = usable.withColumn("_bucket", _bucket(col_named(time), hours))
        cohort = cohort.withColumn("_bucket", F.explode(F.array(first, first + 1)))
        keys.append("_bucket")
    joined = sized_join(usable, cohort, keys, "inner", **join_options).drop("_bucket")
    return joined.filter(in_window(col_named(time), col_named(start), hours))


def window_extract_stored(
    stored: DataFrame, spec: dict, cohort: DataFrame, start: str, value: str, hours: int | None = None, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """`window_extract` over events that `save_bucketed` stored, with `spec` as `bucket_spec` gives it.

    A cohort that fits is broadcast. Beyond that only the cohort is shuffled, to the buckets of the stored events, which
    are read in place, sorted. Windows may be longer or shorter than the stretches (`hours`, the stretch by default): a
    window joins every stretch that it touches, and an event is in one.
    """
    hours = spec["hours"] if hours is None else hours
    first, last = (F.floor((hour_number(col_named(start)) + after) / spec["hours"]).cast("long") for after in (0, hours))
    touched = cohort.withColumn(STRETCH, F.explode(F.sequence(first, last)))
    keys = [*spec["keys"], STRETCH]
    usable = stored.filter(has_number(col_named(value)))
    side = F.broadcast(touched) if fits_broadcast(touched, max_bytes) else touched.hint("merge")
    joined = usable.join(side, keys).drop(STRETCH)
    return joined.filter(in_window(col_named(spec["time"]), col_named(start), hours))


def _most_windows(cohort: DataFrame, on: list[str]) -> int:
    counts = cohort.select(*[col_named(c) for c in on]).dropna().groupBy(*[col_named(c) for c in on]).count()
    return counts.agg(F.max("count")).first()[0] or 0


def _bucket(time: Column, hours: int) -> Column:
    return F.floor(hour_number(time) / hours)


def with_dictionary(events: DataFrame, dictionary: DataFrame, on: list[str], **join_options) -> DataFrame:
    """Adds the dictionary columns; events whose item is not listed are left out."""
    return sized_join(events, dictionary, on, "inner", **join_options)
