"""Operators on the column list of a frame."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from stayline.functions.predicates import col_named

# Identifier and date columns that never enter a model.
ID_AND_DATE_COLUMNS = [
    "icustay_id",
    "subject_id",
    "hadm_id",
    "admittime",
    "dob",
    "dod",
    "intime",
    "outtime",
    "icd9_code",
]


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drops the named columns that exist."""
    return df.drop(*(ID_AND_DATE_COLUMNS if names is None else names))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def keep_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[col_named(c) for c in numeric_columns(df)])


def align_columns(df: DataFrame, names: list[str], fill: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """Exactly `names` in that order; an absent column is filled with `fill` (null by default).

    `keep` columns, such as identifiers, stay in front.
    """
    present = set(df.columns)
    aligned = [
        col_named(n) if n in present else F.lit(fill).cast("double").alias(n) for n in names
    ]
    return df.select(*[col_named(c) for c in keep or []], *aligned)


def leaky_columns(columns: list[str], target: str) -> list[str]:
    """Columns whose name contains the target's name in any case, except the target itself."""
    return [c for c in columns if target.lower() in c.lower() and c != target]


def drop_leaky_columns(df: DataFrame, target: str = "mortality_30d") -> tuple[DataFrame, list[str]]:
    """The frame without columns that name the target, and their list. Reads no data."""
    leaks = leaky_columns(df.columns, target)
    if leaks:
        warnings.warn(f"possible data leakage, dropped: {leaks}", stacklevel=2)
    return df.drop(*leaks), leaks


def null_report(df: DataFrame) -> DataFrame:
    """Number of missing values of every column, one row per column, from one aggregate."""
    counts = []
    for i, field in enumerate(df.schema.fields):
        column = col_named(field.name)
        missing = column.isNull()
        if isinstance(field.dataType, (DoubleType, FloatType)):
            missing = missing | F.isnan(column)
        counts.append(F.count_if(missing).alias(f"_{i}"))
    pairs = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"_{i}").alias("n_missing"))
        for i, name in enumerate(df.columns)
    ]
    return df.agg(*counts).select(F.inline(F.array(*pairs)))


def is_empty(df: DataFrame) -> bool:
    return not df.columns or df.isEmpty()


def select_final(df: DataFrame, ids: list[str], features: list[str], target: str, keep: list[str] | None = None) -> DataFrame:
    """Identifiers, chosen features and target, plus the `keep` columns a caller asks for."""
    names = [*ids, *features, *[c for c in keep or [] if c not in features], target]
    return df.select(*[col_named(c) for c in names])
