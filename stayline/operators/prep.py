"""Split, median imputation, scaling, one-hot encoding and sampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from stayline.functions.predicates import col_named, has_number, number_or_null
from stayline.operators.columns import drop_columns, numeric_columns
from stayline.operators.joins import sized_join
from stayline.operators.radix import exact_quantiles
from stayline.sources.tables import materialize

HASH_BITS = 60
HASH_STEP = 20
MAX_LEVELS = 1_000


# ---------------------------------------------------------------- split and sample


def order_hash(key: list[str], seed: int) -> Column:
    """A 60-bit number from seed and key: the same on every run, machine and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col_named(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_cutoffs(hashed: DataFrame, strata: list[str], wanted: Column) -> DataFrame:
    """Per stratum the smallest hash `cut` such that `wanted` rows have a hash up to it.

    `wanted` is a column over `n_rows`, the size of the stratum. Three histograms of at most 2^20
    counts each: over the upper bits of the hash, then over the next ones inside the one bin where the
    cut falls, and so on. No task ever sorts the rows. Each step leaves one row per stratum, which is
    written, so that no pass runs twice; `hashed` is read three times and should be stored.
    """
    by = [col_named(s) for s in strata]
    whole = W.partitionBy(*by)
    found = None
    for shift in range(HASH_BITS - HASH_STEP, -1, -HASH_STEP):
        inside, carried = hashed, []
        if found is not None:
            inside = sized_join(hashed.withColumn("_bin", F.shiftright("_hash", shift + HASH_STEP)), found, [*strata, "_bin"])
            carried = [F.first("_left").alias("_left")]
        bins = inside.groupBy(*by, F.shiftright("_hash", shift).alias("_bin_")).agg(F.count(F.lit(1)).alias("_n"), *carried)
        bins = bins.withColumn("_upto", F.sum("_n").over(whole.orderBy("_bin_")))
        if found is None:
            bins = bins.withColumn("n_rows", F.sum("_n").over(whole)).withColumn("_left", wanted)
        at = (F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left"))
        left = F.col("_left") - (F.col("_upto") - F.col("_n"))
        found = materialize(bins.filter(at).select(*by, F.col("_bin_").alias("_bin"), left.alias("_left")))
    return found.select(*by, F.col("_bin").alias("cut"))


def hash_split(
    df: DataFrame,
    key: list[str],
    test_size: float = 0.2,
    seed: int = 42,
    stratify_by: str | None = None,
) -> DataFrame:
    """Adds `is_test`, decided by a hash of the key, so that a rerun splits the same way.

    Without strata each row is decided alone, with no shuffle; the share is met on average.
    With `stratify_by` each stratum gives ceil(test_size * n) rows to the test set (rows with
    equal keys stay together). Use an entity as key to keep all its rows on one side.
    """
    hashed = df.withColumn("_hash", order_hash(key, seed))
    if stratify_by is None:
        limit = int(test_size * (1 << HASH_BITS))
        return hashed.withColumn("is_test", F.col("_hash") < limit).drop("_hash")
    if test_size <= 0:
        return df.withColumn("is_test", F.lit(False))
    known = materialize(hashed.select(col_named(stratify_by).alias("_stratum"), "_hash").dropna())
    cuts = hash_cutoffs(known, ["_stratum"], F.ceil(F.col("n_rows") * F.lit(test_size)))
    cut = sized_join(hashed.withColumn("_stratum", col_named(stratify_by)), cuts, ["_stratum"], "left")
    is_test = F.coalesce(F.col("_hash") <= F.col("cut"), F.lit(False))
    return cut.select(*[col_named(c) for c in df.columns], is_test.alias("is_test"))


def split_parts(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a frame marked by `hash_split`."""
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    column = col_named(target)
    is_number = isinstance(df.schema[target].dataType, (DoubleType, FloatType))
    return df.filter(has_number(column) if is_number else column.isNotNull())


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of at most `n` rows: those with the smallest hash of the key.

    The hash up to which rows are taken comes from histograms of the stored hashes, whatever `n` is; rows
    that share the last hash fill up in the order of their keys.
    """
    hashed = df.withColumn("_hash", order_hash(key, seed))
    stored = materialize(hashed.select(F.lit(0).alias("_all"), "_hash"))
    limit = hash_cutoffs(stored, ["_all"], F.least(F.col("n_rows"), F.lit(n))).select(F.max("cut")).first()[0]
    if limit is None:
        return df.limit(0)
    below = hashed.filter(F.col("_hash") < limit)
    room = n - stored.filter(F.col("_hash") < limit).count()
    last = hashed.filter(F.col("_hash") == limit).orderBy(*[col_named(k) for k in key]).limit(room)
    return below.unionByName(last).drop("_hash")


# ---------------------------------------------------------------- impute and scale


def fit_medians(
    train: DataFrame, columns: list[str] | None = None, accuracy: int | None = None
) -> dict[str, float | None]:
    """Median of every numeric column: exact, or an approximate percentile with `accuracy`."""
    names = numeric_columns(train) if columns is None else columns
    if accuracy is None or not names:
        return exact_quantiles(train, names)
    row = train.agg(
        *[F.percentile_approx(number_or_null(col_named(c).cast("double")), 0.5, accuracy).alias(f"_{i}") for i, c in enumerate(names)]
    ).first()
    return {c: row[f"_{i}"] for i, c in enumerate(names)}


def apply_medians(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    """Missing values of the fitted columns become the median, as doubles."""
    return df.select(
        *[
            F.coalesce(number_or_null(col_named(c).cast("double")), F.lit(medians[c]).cast("double")).alias(c)
            if c in medians
            else col_named(c)
            for c in df.columns
        ]
    )


def prepare_for_inference(
    df: DataFrame, medians: Mapping[str, float | None] | None = None, drop: list[str] | None = None
) -> DataFrame:
    """Drops identifiers and fills gaps: with the given medians, or with those of `df` itself."""
    rest = drop_columns(df, drop)
    return apply_medians(rest, fit_medians(rest) if medians is None else medians)


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a constant column gets deviation 1."""
    row = train.agg(
        *[F.avg(col_named(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(col_named(c)).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"d{i}"] or 1.0) for i, c in enumerate(columns)}


def scale_columns(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select(
        *[
            ((col_named(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias(c) if c in scaler else col_named(c)
            for c in df.columns
        ]
    )


# ---------------------------------------------------------------- one-hot


def column_levels(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct values. Too many is an error: such a column is no category."""
    rows = df.select(col_named(column)).distinct().dropna().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(row[0] for row in rows)


def one_hot(
    df: DataFrame,
    columns: list[str] | None = None,
    drop_first: bool = True,
    levels: Mapping[str, list[str]] | None = None,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """Replaces each column by 0/1 columns `{column}_{level}`, without the first level if asked.

    A null is 0 in all of them. The new columns follow the untouched ones. Without `columns`
    every text column is encoded; one with more than `max_levels` values raises.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    rest = [col_named(c) for c in df.columns if c not in columns]
    flags = []
    for name in columns:
        values = (levels or {}).get(name) or column_levels(df, name, max_levels)
        for value in values[1:] if drop_first else values:
            flags.append(F.coalesce((col_named(name) == value).cast("int"), F.lit(0)).alias(f"{name}_{value}"))
    return df.select(*rest, *flags)


