"""Questions asked of the finished cohort: filters, lookups, trends and input ranges."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named, contains_any_case, equals_any_case
from stayline.operators.joins import sized_join
from stayline.sources.tables import materialize

# Columns of the cohort listing.
LISTING = ["subject_id", "age", "gender", "icustay_id", "mortality_30d"]

# Feature -> (label, lowest, highest, default) of the manual entry form.
FEATURE_INFO = {
    "mean_glucose": ("Mean Glucose (mg/dL)", 50.0, 300.0, 100.0),
    "min_heart_rate": ("Min Heart Rate (bpm)", 40.0, 180.0, 60.0),
    "mean_urea_nitrogen": ("Mean BUN (mg/dL)", 5.0, 100.0, 18.0),
    "slope_chloride": ("Slope of Chloride", -5.0, 5.0, 0.0),
    "max_bicarbonate": ("Max Bicarbonate (mEq/L)", 10.0, 40.0, 24.0),
    "mean_rdw": ("Mean RDW (%)", 10.0, 20.0, 13.5),
    "min_white_blood_cells": ("Min WBC (K/uL)", 1.0, 30.0, 6.0),
    "mean_mchc": ("Mean MCHC (g/dL)", 30.0, 38.0, 34.0),
    "mean_chloride": ("Mean Chloride (mEq/L)", 95.0, 115.0, 105.0),
    "slope_bicarbonate": ("Slope of Bicarbonate", -5.0, 5.0, 0.0),
}

FeatureInfo = dict[str, tuple[str, float, float, float]]


def explore_cohort(
    df: DataFrame,
    gender: str | None = None,
    ages: tuple[float, float] = (18, 89),
    gender_col: str = "gender",
    age_col: str = "age",
    listing: list[str] | None = None,
) -> DataFrame:
    """Cohort rows by gender (None: all) and inclusive age range, with the listed columns."""
    rows = df.filter(col_named(age_col).between(*ages))
    if gender is not None:
        rows = rows.filter(col_named(gender_col) == gender)
    return rows.select(*[col_named(c) for c in (LISTING if listing is None else listing)])


def subjects(df: DataFrame, subject: str = "subject_id") -> DataFrame:
    """The distinct subjects."""
    return df.select(col_named(subject)).distinct()


def lookup_subjects(df: DataFrame, wanted: DataFrame | list, subject: str = "subject_id") -> DataFrame:
    """Rows of the wanted subjects: a list of ids, or a frame with a column of them."""
    if isinstance(wanted, DataFrame):
        # Stored once: the join measures the list before it uses it.
        return sized_join(df, materialize(subjects(wanted, subject)), [subject], "left_semi")
    return df.filter(col_named(subject).isin(wanted))


def trend_series(
    df: DataFrame,
    entity: str,
    time: str,
    value: str,
    label: str,
    labels: list[str],
    match: str = "exact",
    wanted: DataFrame | list | None = None,
) -> DataFrame:
    """The readings of some labels in time order, for all entities or the wanted ones.

    `match` is "exact" (whole label) or "contains" (part of it), both in any case.
    """
    if match not in ("exact", "contains"):
        raise ValueError(f"unsupported match: {match}")
    test = equals_any_case if match == "exact" else contains_any_case
    rows = df.filter(reduce(or_, [test(col_named(label), name) for name in labels]))
    if wanted is not None:
        rows = lookup_subjects(rows, wanted, entity)
    picked = [col_named(c) for c in (entity, label, time, value)]
    return rows.select(*picked).orderBy(col_named(entity), col_named(time), col_named(label), col_named(value))


def range_violations(df: DataFrame, ids: list[str], info: FeatureInfo | None = None) -> DataFrame:
    """One row per value outside the range its feature allows."""
    rules = {f: rule for f, rule in (FEATURE_INFO if info is None else info).items() if f in df.columns}
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(label).alias("label"),
            col_named(name).cast("double").alias("value"),
            F.lit(float(low)).alias("lowest"),
            F.lit(float(high)).alias("highest"),
        )
        for name, (label, low, high, _) in rules.items()
    ]
    outside = F.filter(
        F.array(*cells), lambda c: ~c["value"].between(c["lowest"], c["highest"])
    )
    return df.select(*[col_named(c) for c in ids], F.inline(outside))


def missing_info(features: list[str], info: FeatureInfo | None = None) -> list[str]:
    """Expected features that the form does not describe."""
    known = FEATURE_INFO if info is None else info
    return [f for f in features if f not in known]


def default_inputs(features: list[str], info: FeatureInfo | None = None) -> dict[str, float]:
    """The form's default per feature, 0 where it describes none."""
    known = FEATURE_INFO if info is None else info
    return {f: known[f][3] if f in known else 0.0 for f in features}
