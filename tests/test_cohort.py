from datetime import datetime, timedelta

import numpy as np
import pytest

from stayline.operators.cohort import first_per_key, one_row_per_stay
from stayline.operators.extract import window_extract
from stayline.plans.cohort import COHORT_COLUMNS, build_cohort, extract_labs, extract_vitals

STAY = "subject_id INT, hadm_id INT, icustay_id INT, intime TIMESTAMP_NTZ, outtime TIMESTAMP_NTZ"


@pytest.fixture(scope="module")
def tables(spark, at):
    day = at("2150-01-01 10:00")
    people = [(1, "M"), (2, "F"), (3, "M"), (4, "F"), (5, "F")]
    return {
        "patients": spark.createDataFrame(
            [(s, g, at("2100-01-01"), at("2150-01-20") if s == 1 else None) for s, g in people],
            "subject_id INT, gender STRING, dob TIMESTAMP_NTZ, dod TIMESTAMP_NTZ",
        ),
        "admissions": spark.createDataFrame(
            [(1, 10, day, "W", "S", "P", "E"), (2, 20, day, "W", "S", "P", "E"), (2, 21, at("2150-02-01"), "W", "S", "P", "E"),
             (3, 30, day, "W", "S", "P", "E"), (4, 40, at("2110-01-01"), "W", "S", "P", "E"), (5, 50, day, "W", "S", "P", "E")],
            """subject_id INT, hadm_id INT, admittime TIMESTAMP_NTZ, ethnicity STRING, marital_status STRING,
               insurance STRING, admission_type STRING""",
        ),
        "stays": spark.createDataFrame(
            [
                (1, 10, 100, day, at("2150-01-03 10:00")),
                (2, 20, 200, day, at("2150-01-02 10:00")),
                (2, 21, 201, at("2150-02-01"), at("2150-02-02")),
                (3, 30, 300, day, at("2150-01-03 10:00:01")),
                (4, 40, 400, at("2110-01-01"), at("2110-01-02")),
                (5, 50, 500, day, None),
            ],
            STAY,
        ),
        "diagnoses": spark.createDataFrame(
            [(1, 10, "1400"), (1, 10, "1400"), (1, 10, "1410"), (1, 10, "V1000"), (2, 21, "1400"), (3, 30, "1400"),
             (4, 40, "1400"), (5, 50, "1400")],
            "subject_id INT, hadm_id INT, icd9_code STRING",
        ),
        "dictionary": spark.createDataFrame(
            [("1400", "a", "Malignant a"), ("1410", "b", "neoplasm b"), ("V1000", "v", "Malignant v")],
            "icd9_code STRING, short_title STRING, long_title STRING",
        ),
    }


@pytest.fixture(scope="module")
def cohort(tables):
    return build_cohort(*[tables[n] for n in ("patients", "admissions", "stays", "diagnoses", "dictionary")])


def test_cohort_has_one_row_per_stay_and_code(cohort):
    """Subject 1 stays with two codes and the repeated one once.

    Out: 2 (first stay without code), 3 (a second too long), 4 (a child), 5 (no end).
    """
    rows = sorted((r.subject_id, r.icd9_code, r.age, r.mortality_30d) for r in cohort.collect())
    assert rows == [(1, "1400", 49, 1), (1, "1410", 49, 1)]
    assert cohort.columns == COHORT_COLUMNS
    assert one_row_per_stay(cohort, "icustay_id", "icd9_code").count() == 1


def test_first_per_key_breaks_ties_and_keeps_nulls_last(spark, at):
    df = spark.createDataFrame(
        [(1, at("2150-01-01"), 8), (1, at("2150-01-01"), 7), (1, None, 1), (2, None, 9)],
        "k INT, t TIMESTAMP_NTZ, id INT",
    )
    for parts in (1, 7):
        first = first_per_key(df.repartition(parts), ["k"], ["t", "id"])
        assert sorted((r.k, r.id) for r in first.collect()) == [(1, 7), (2, 9)]


def test_extracts_fan_out_over_codes(spark, at, cohort):
    labs = spark.createDataFrame(
        [
            (1, 10, 1, at("2150-01-01 10:00"), 1.0, "u", None),
            (1, 10, 1, at("2150-01-03 10:00"), 2.0, "u", None),
            (1, 10, 1, at("2150-01-03 10:00:01"), 3.0, "u", None),
            (1, 10, 1, at("2150-01-01 09:59:59"), 4.0, "u", None),
            (1, 10, 1, at("2150-01-02"), None, "u", None),
            (1, 10, 1, at("2150-01-02"), float("nan"), "u", None),
            (1, 10, 9, at("2150-01-02"), 6.0, "u", None),
            (1, 11, 1, at("2150-01-02"), 7.0, "u", None),
        ],
        """subject_id INT, hadm_id INT, itemid INT, charttime TIMESTAMP_NTZ, valuenum DOUBLE, valueuom STRING,
           flag STRING""",
    )
    items = spark.createDataFrame([(1, "Glucose", "Blood", "Chemistry")], "itemid INT, label STRING, fluid STRING, category STRING")
    rows = extract_labs(labs, cohort, items)
    assert sorted((r.icd9_code, r.labs_valuenum) for r in rows.collect()) == [
        ("1400", 1.0), ("1400", 2.0), ("1410", 1.0), ("1410", 2.0)]
    assert rows.columns == [
        "subject_id", "hadm_id", "icustay_id", "icd9_code", "short_title", "itemid", "labs_label", "fluid",
        "labs_category", "charttime", "labs_valuenum", "labs_valueom", "flag"]


def test_vitals_day_granularity_drops_the_first_day(spark, at, cohort):
    events = spark.createDataFrame(
        [(100, 7, at("2150-01-01 12:00"), 80.0, "bpm"), (100, 7, at("2150-01-02 12:00"), 81.0, "bpm")],
        "icustay_id INT, itemid INT, charttime TIMESTAMP_NTZ, valuenum DOUBLE, valueuom STRING",
    )
    items = spark.createDataFrame([(7, "Heart Rate", "Vital", "mv")], "itemid INT, label STRING, category STRING, dbsource STRING")
    full = extract_vitals(events, cohort, items)
    daily = extract_vitals(events, cohort, items, time_granularity="day")
    assert sorted(r.vitals_valuenum for r in full.collect()) == [80.0, 80.0, 81.0, 81.0]
    assert sorted((r.vitals_valuenum, r.charttime) for r in daily.collect()) == [(81.0, at("2150-01-02"))] * 2


def test_window_rejects_unknown_granularity(spark, cohort):
    with pytest.raises(ValueError):
        window_extract(cohort, cohort, ["icustay_id"], "intime", "intime", "age", time_granularity="hour")


@pytest.mark.parametrize("base", ["2150-01-01", "1969-12-20"])
@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_many_windows_on_one_key_equal_brute_force(spark, base, max_bytes):
    rng = np.random.default_rng(6)
    zero = datetime.fromisoformat(base)
    minutes = rng.integers(0, 20 * 24 * 60, 300)
    starts = [zero + timedelta(minutes=int(m)) for m in minutes[:60]]
    times = [zero + timedelta(minutes=int(m)) for m in minutes[60:]]
    times += [starts[0], starts[0] + timedelta(hours=48), starts[1] + timedelta(hours=48, microseconds=1)]
    cohort = spark.createDataFrame([(1, i, s) for i, s in enumerate(starts)], "k INT, w INT, s TIMESTAMP_NTZ")
    events = spark.createDataFrame([(1, i, t, 1.0) for i, t in enumerate(times)], "k INT, e INT, t TIMESTAMP_NTZ, v DOUBLE")
    wanted = sorted((w, e) for w, s in enumerate(starts) for e, t in enumerate(times) if s <= t <= s + timedelta(hours=48))
    for crowded in (16, 1000):
        rows = window_extract(events, cohort, ["k"], "t", "s", "v", crowded_key=crowded, max_bytes=max_bytes, sample=1.0)
        assert rows.columns == ["k", "e", "t", "v", "w", "s"]
        assert sorted((r.w, r.e) for r in rows.collect()) == wanted
