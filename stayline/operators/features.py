"""Coverage, time-series features, pivot, merge and the sparse-column rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from stayline.functions.predicates import col_named, has_number, hours_between
from stayline.operators.joins import sized_join
from stayline.sources.tables import materialize

STATS = ("mean", "min", "max", "slope")
MAX_LABELS = 10_000


def label_coverage(df: DataFrame, label: str, entity: str, approx: bool = False) -> DataFrame:
    """Per label: in how many entities it occurs, and their share of all entities in `df`.

    The distinct (label, entity) pairs are found in one pass, by partial aggregates that neither a
    frequent label nor a frequent entity brings into one task, and written; both counts read the pairs.
    """
    pairs = df.select(col_named(label), col_named(entity))
    if not approx:
        pairs = materialize(pairs.distinct())
    distinct = F.approx_count_distinct if approx else F.countDistinct
    total = pairs.select(distinct(col_named(entity)).alias("n")).scalar()
    return (
        pairs.filter(col_named(label).isNotNull())
        .groupBy(col_named(label))
        .agg(distinct(col_named(entity)).alias("n_entities"))
        .withColumn("coverage", F.col("n_entities") / total)
    )


def high_coverage_labels(
    df: DataFrame, label: str, entity: str, min_coverage: float, max_labels: int = MAX_LABELS, approx: bool = False
) -> list[str]:
    """Names of the labels that reach the coverage, sorted. Raises beyond `max_labels`."""
    kept = label_coverage(df, label, entity, approx).filter(F.col("coverage") >= min_coverage)
    return _names(kept.select(col_named(label)), max_labels)


def filter_high_coverage(
    df: DataFrame, label: str, entity: str, min_coverage: float = 0.95, labels: list[str] | None = None
) -> DataFrame:
    """Rows whose label occurs in at least `min_coverage` of the entities.

    With the label names given it is a plain filter, which reaches the scan. Otherwise the labels are
    found, stored and joined in, however many they are.
    """
    if labels is not None:
        return df.filter(col_named(label).isin(labels))
    kept = label_coverage(df, label, entity).filter(F.col("coverage") >= min_coverage)
    return sized_join(df, materialize(kept.select(col_named(label))), [label], "left_semi")


def time_series_long(
    df: DataFrame,
    entity: list[str],
    label: str,
    time: str,
    value: str,
    origin: Column | None = None,
) -> DataFrame:
    """Mean, min, max and least-squares slope per hour of every (entity, label) series.

    One aggregate with partial sums before the shuffle. A single reading has no slope;
    readings that all share one time have slope 0. Times count from `origin`, which should be near
    the readings (such as the window start): far from it the sums lose the slope. Without one they count
    from the entity's first reading, found by one more aggregate and joined in.
    """
    used = df.filter(has_number(col_named(value)) & col_named(label).isNotNull())
    if origin is None:
        used, origin = with_first_time(used, entity, time)
    # The time axis is a column of its own, so that it is computed once per reading.
    series = used.select(
        *[col_named(e) for e in entity],
        col_named(label),
        col_named(value).cast("double").alias("_value"),
        col_named(time).alias("_time"),
        hours_between(origin, col_named(time)).alias("_hours"),
    )
    return series.groupBy(*[col_named(e) for e in entity], col_named(label)).agg(
        F.avg("_value").alias("mean"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
        F.when(F.count("_value") == 1, F.lit(None))
        .when(F.min("_time") == F.max("_time"), F.lit(0.0))
        .otherwise(F.regr_slope("_value", "_hours"))
        .alias("slope"),
    )


def with_first_time(df: DataFrame, entity: list[str], time: str) -> tuple[DataFrame, Column]:
    """The rows joined with the earliest time of their entity, and that time; entities that are null keep the epoch."""
    first = df.groupBy(*[col_named(e) for e in entity]).agg(F.min(col_named(time)).alias("_first"))
    joined = sized_join(df, materialize(first), entity, "left")
    return joined, F.coalesce(F.col("_first"), F.lit("1970-01-01").cast("timestamp_ntz"))


# How a generated column is named.
def feature_name(stat: str, label: str) -> str:
    return f"{stat}_{label}".lower().replace(" ", "_")


def pivot_features(
    long: DataFrame,
    entity: list[str],
    label: str,
    labels: list[str] | None = None,
    stats: tuple[str, ...] = STATS,
    max_labels: int = MAX_LABELS,
) -> DataFrame:
    """One row per entity with a column `{stat}_{label}` for every statistic and label.

    With `labels` given the schema is known without a job; otherwise their names are read first.
    """
    if labels is None:
        labels = _names(long.select(col_named(label)).distinct(), max_labels)
    names = [feature_name(stat, name) for stat in stats for name in labels]
    if len(set(names)) < len(names):
        twice = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"labels that give the same feature name: {twice}")
    if not labels:
        return long.select(*[col_named(e) for e in entity]).distinct()
    wide = (
        long.groupBy(*[col_named(e) for e in entity])
        .pivot(label, labels)
        .agg(*[F.first(col_named(stat)).alias(stat) for stat in stats])
    )
    if len(stats) > 1:
        cells = {(stat, name): f"{name}_{stat}" for stat in stats for name in labels}
    else:
        cells = {(stats[0], name): name for name in labels}
    return wide.select(
        *[col_named(e) for e in entity],
        *[col_named(cell).alias(feature_name(*key)) for key, cell in cells.items()],
    )


def time_series_features(
    df: DataFrame,
    entity: list[str],
    label: str,
    time: str,
    value: str,
    labels: list[str] | None = None,
    origin: Column | None = None,
    max_labels: int = MAX_LABELS,
) -> DataFrame:
    """Wide features of long measurements: `time_series_long` followed by `pivot_features`."""
    long = time_series_long(df, entity, label, time, value, origin)
    return pivot_features(long, entity, label, labels, max_labels=max_labels)


def merge_features(base: DataFrame, *features: DataFrame, on: list[str], **join_options) -> DataFrame:
    """Left joins of feature sets onto the base rows.

    A column name on both sides gets the suffix `_x` on the left and `_y` on the right. Each set
    is measured before it is joined: pass sets that are stored, not long computations.
    """
    merged = base
    for side in features:
        shared = [c for c in side.columns if c not in on and c in merged.columns]
        left = merged.withColumnsRenamed({c: f"{c}_x" for c in shared})
        right = side.withColumnsRenamed({c: f"{c}_y" for c in shared})
        names = left.columns + [c for c in right.columns if c not in on]
        if len(set(names)) < len(names):
            raise ValueError(f"merge gives equal column names: {sorted(n for n in names if names.count(n) > 1)}")
        merged = sized_join(left, right, on, "left", **join_options).select(*[col_named(c) for c in names])
    return merged


def column_coverage(df: DataFrame) -> DataFrame:
    """Share of filled values of every column, one row per column, from one aggregate; null if there are no rows."""
    total = F.count(F.lit(1))
    filled = []
    for i, field in enumerate(df.schema.fields):
        column = col_named(field.name)
        present = column.isNotNull()
        if isinstance(field.dataType, (DoubleType, FloatType)):
            present = present & ~F.isnan(column)
        filled.append(F.try_divide(F.count_if(present), total).alias(f"_{i}"))
    shares = df.agg(*filled)
    pairs = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"_{i}").alias("coverage"))
        for i, name in enumerate(df.columns)
    ]
    return shares.select(F.inline(F.array(*pairs)))


def drop_sparse_columns(
    df: DataFrame,
    min_coverage: float = 0.8,
    protect: list[str] | None = None,
    ignore: list[str] | None = None,
) -> DataFrame:
    """Keeps the columns filled in more than `min_coverage` of the rows.

    `protect` columns always stay, `ignore` columns always go; by default the rule covers all.
    """
    shares = {row.column_name: row.coverage for row in column_coverage(df).collect()}
    always, never = set(protect or []), set(ignore or [])
    kept = [
        c
        for c in df.columns
        if c not in never and (c in always or (shares[c] is not None and shares[c] > min_coverage))
    ]
    return df.select(*[col_named(c) for c in kept])


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any null or NaN, whatever the columns are called."""
    whole = F.lit(True)
    for field in df.schema.fields:
        column = col_named(field.name)
        whole = whole & (has_number(column) if isinstance(field.dataType, (DoubleType, FloatType)) else column.isNotNull())
    return df.filter(whole)


def drop_sparse_complete(df: DataFrame, min_coverage: float = 0.8, **column_rules) -> DataFrame:
    """The sparse-column rule, then the complete rows only. Nothing is imputed."""
    return complete_rows(drop_sparse_columns(df, min_coverage, **column_rules))


def _names(column: DataFrame, limit: int) -> list[str]:
    """A short list of names on the driver, sorted. Too many is an error, never a cut."""
    rows = column.dropna().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels: give the labels as an argument")
    return sorted(row[0] for row in rows)
