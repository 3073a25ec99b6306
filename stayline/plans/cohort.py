"""The cohort and its two 48-hour measurement extracts, with clinical column names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.predicates import age_in_years, col_named, outcome_within_days
from stayline.operators.cohort import first_per_key, select_codes, short_stays
from stayline.operators.extract import window_extract, with_dictionary
from stayline.operators.joins import sized_join


@dataclass(frozen=True)
class CohortRules:
    """Who belongs to the cohort. The defaults of the clinical study."""

    code_range: tuple[int, int] = (140, 239)
    title_patterns: list[str] = field(default_factory=lambda: ["%malignant%", "%neoplasm%"])
    max_hours: float = 48
    ages: tuple[int, int] = (18, 89)
    outcome_days: int = 30


# Column order of the cohort.
COHORT_COLUMNS = [
    "subject_id", "hadm_id", "icustay_id", "icd9_code", "short_title", "intime", "outtime", "gender", "dob", "dod",
    "admittime", "ethnicity", "marital_status", "insurance", "admission_type", "age", "mortality_30d",
]

# Cohort columns that an extract carries along.
EXTRACT_KEYS = ["subject_id", "hadm_id", "icustay_id", "icd9_code", "short_title"]


def build_cohort(
    patients: DataFrame,
    admissions: DataFrame,
    stays: DataFrame,
    diagnoses: DataFrame,
    dictionary: DataFrame,
    rules: CohortRules | None = None,
) -> DataFrame:
    """One row per (first stay, matching code) of adult patients with a short first stay.

    The first stay is chosen among all stays before the codes are looked at: a patient
    whose first stay has no matching code is out, and no later stay moves up.
    """
    rules = rules or CohortRules()
    admission = ["subject_id", "hadm_id"]
    codes = select_codes(dictionary, "icd9_code", "long_title", rules.code_range, rules.title_patterns)
    matching = sized_join(
        diagnoses.select(*admission, "icd9_code"), codes.select("icd9_code", "short_title"), ["icd9_code"]
    ).distinct()
    first = first_per_key(
        stays.select(*admission, "icustay_id", "intime", "outtime"), ["subject_id"], ["intime", "icustay_id"]
    )
    short = short_stays(first, "intime", "outtime", rules.max_hours)
    admitted = admissions.select(
        *admission, "admittime", "ethnicity", "marital_status", "insurance", "admission_type"
    )
    # Admissions join on the full key and patients last: a subject with very many
    # admissions is spread by admission and only meets the few rows of the cohort.
    joined = (
        short.join(matching, admission)
        .join(admitted, admission)
        .join(patients.select("subject_id", "gender", "dob", "dod"), "subject_id")
    )
    aged = joined.withColumn("age", age_in_years(F.col("dob"), F.col("admittime")))
    return (
        aged.filter(F.col("age").between(*rules.ages))
        .withColumn("mortality_30d", outcome_within_days(F.col("admittime"), F.col("dod"), rules.outcome_days))
        .select(*COHORT_COLUMNS)
    )


def extract_labs(labevents: DataFrame, cohort: DataFrame, items: DataFrame, hours: int = 48, **options) -> DataFrame:
    """Lab values of the cohort's admissions within `hours` of the start of the stay."""
    events = labevents.select("subject_id", "hadm_id", "itemid", "charttime", "valuenum", "valueuom", "flag")
    rows = window_extract(
        events, cohort.select(*EXTRACT_KEYS, "intime"), ["subject_id", "hadm_id"], "charttime", "intime", "valuenum",
        hours, **options,
    )
    listed = items.select("itemid", F.col("label").alias("labs_label"), "fluid", F.col("category").alias("labs_category"))
    return with_dictionary(rows, listed, ["itemid"]).select(
        *EXTRACT_KEYS, "itemid", "labs_label", "fluid", "labs_category", "charttime",
        col_named("valuenum").alias("labs_valuenum"), col_named("valueuom").alias("labs_valueom"), "flag",
    )


def extract_vitals(chartevents: DataFrame, cohort: DataFrame, items: DataFrame, hours: int = 48, **options) -> DataFrame:
    """Chart values of the cohort's stays within `hours` of their start."""
    events = chartevents.select("icustay_id", "itemid", "charttime", "valuenum", "valueuom")
    rows = window_extract(
        events, cohort.select(*EXTRACT_KEYS, "intime"), ["icustay_id"], "charttime", "intime", "valuenum", hours,
        **options,
    )
    listed = items.select(
        "itemid", F.col("label").alias("vitals_label"), F.col("category").alias("vitals_category"), "dbsource"
    )
    return with_dictionary(rows, listed, ["itemid"]).select(
        *EXTRACT_KEYS, "itemid", "vitals_label", "vitals_category", "dbsource", "charttime",
        col_named("valuenum").alias("vitals_valuenum"), col_named("valueuom").alias("vitals_valueuom"),
    )
