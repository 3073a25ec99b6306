"""Time-series features that take in new readings without reading the old ones.

What is stored of a series (entity, label) is small and merges: its number of readings, the means of hours and values, their
sums of squares and products about these means, the extremes and the first and last time. Features follow from it, and equal
those of one pass over all readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named, has_number, hours_between
from stayline.sources.published import publish_table, read_published

PARTS = ["n", "mean_hours", "mean_value", "hours_sq", "hours_value", "low", "high", "first", "last"]


def series_parts(df: DataFrame, entity: list[str], label: str, time: str, value: str, origin: Column) -> DataFrame:
    """One row per (entity, label) series with PARTS: one aggregate with partial sums.

    Hours count from `origin`, which has to be the same for a series in every load, and near its readings. Readings without a
    number and without a label say nothing.
    """
    used = df.filter(has_number(col_named(value)) & col_named(label).isNotNull()).select(
        *[col_named(e) for e in entity],
        col_named(label),
        col_named(value).cast("double").alias("_value"),
        col_named(time).alias("_time"),
        hours_between(origin, col_named(time)).alias("_hours"),
    )
    n = F.count(F.lit(1))
    return used.groupBy(*[col_named(c) for c in [*entity, label]]).agg(
        n.alias("n"),
        F.avg("_hours").alias("mean_hours"),
        F.avg("_value").alias("mean_value"),
        (F.var_pop("_hours") * n).alias("hours_sq"),
        (F.covar_pop("_hours", "_value") * n).alias("hours_value"),
        F.min("_value").alias("low"),
        F.max("_value").alias("high"),
        F.min("_time").alias("first"),
        F.max("_time").alias("last"),
    )


def merge_parts(parts: DataFrame, entity: list[str], label: str) -> DataFrame:
    """One row per series out of any number of rows of PARTS, in any order."""
    n, x, y = F.col("n"), F.col("mean_hours"), F.col("mean_value")
    sums = parts.groupBy(*[col_named(c) for c in [*entity, label]]).agg(
        F.count(F.lit(1)).alias("_parts"),
        F.sum("n").alias("n"),
        F.sum(n * x).alias("_x"),
        F.sum(n * y).alias("_y"),
        F.sum(n * x * x).alias("_xx"),
        F.sum(n * x * y).alias("_xy"),
        F.sum("hours_sq").alias("_hours_sq"),
        F.sum("hours_value").alias("_hours_value"),
        *[F.min(c).alias(c) for c in ("low", "first")],
        *[F.max(c).alias(c) for c in ("high", "last")],
    )
    mean_x, mean_y = F.col("_x") / n, F.col("_y") / n
    # A series of one part stays what it is, to the last digit.
    between = lambda whole, part: F.when(F.col("_parts") == 1, F.col(part)).otherwise(F.col(part) + whole)
    return sums.select(
        *[col_named(c) for c in [*entity, label]],
        "n",
        mean_x.alias("mean_hours"),
        mean_y.alias("mean_value"),
        between(F.col("_xx") - n * mean_x * mean_x, "_hours_sq").alias("hours_sq"),
        between(F.col("_xy") - n * mean_x * mean_y, "_hours_value").alias("hours_value"),
        "low",
        "high",
        "first",
        "last",
    )


def features_of_parts(parts: DataFrame, entity: list[str], label: str) -> DataFrame:
    """(entity, label, mean, min, max, slope) as `time_series_long` gives them, from one row of PARTS a series."""
    slope = F.when(F.col("n") == 1, F.lit(None)).when(F.col("first") == F.col("last"), F.lit(0.0))
    return parts.select(
        *[col_named(c) for c in [*entity, label]],
        F.col("mean_value").alias("mean"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        slope.otherwise(F.col("hours_value") / F.col("hours_sq")).alias("slope"),
    )


def refresh_features(
    spark: SparkSession, path: str, new: DataFrame, entity: list[str], label: str, time: str, value: str, origin: Column
) -> DataFrame:
    """Takes new readings into the published parts at `path` (made by the first load) and gives the features of all so far.

    Only the new readings and the stored parts are read. A load that fails leaves the parts as they were; one that is repeated
    counts its readings twice, so publish the readings and their parts under one load number, or load again from the start.
    """
    parts = series_parts(new, entity, label, time, value, origin)
    old = read_published(spark, path, parts.schema).select(*parts.columns)
    merged = publish_table(merge_parts(old.unionByName(parts), entity, label), path)
    return features_of_parts(merged, entity, label)
