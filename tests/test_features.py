import io
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.operators import features as FT

LONG = "stay INT, label STRING, t TIMESTAMP_NTZ, v DOUBLE"


def readings(spark, at, rows):
    return spark.createDataFrame([(s, n, at(f"2150-01-01 {t}"), v) for s, n, t, v in rows], LONG)


def test_label_coverage_boundary_is_inclusive(spark, at):
    rows = [(s, "A", "01:00", 1.0) for s in range(10)]
    rows += [(s, "B", "01:00", 1.0) for s in range(7) for _ in range(3)]
    rows += [(s, "C", "01:00", 1.0) for s in range(6)]
    df = readings(spark, at, rows)
    assert FT.high_coverage_labels(df, "label", "stay", 0.7) == ["A", "B"]
    for labels in (None, ["A", "B"]):
        kept = FT.filter_high_coverage(df, "label", "stay", 0.7, labels)
        assert kept.count() == 31
    with pytest.raises(ValueError):
        FT.high_coverage_labels(df, "label", "stay", 0.1, max_labels=2)


def test_slope_rules(spark, at):
    rows = [(1, "one", "01:00", 5.0), (1, "same", "01:00", 5.0), (1, "same", "01:00", 7.0)]
    rows += [(1, "line", f"0{h}:00", 1.0 + 2 * h) for h in range(3)]
    for origin in (None, F.lit("2150-01-01").cast("timestamp_ntz")):
        long = FT.time_series_long(readings(spark, at, rows), ["stay"], "label", "t", "v", origin)
        got = {r.label: (r["mean"], r["min"], r["max"], r.slope) for r in long.collect()}
        assert got["one"] == (5.0, 5.0, 5.0, None)
        assert got["same"] == (6.0, 5.0, 7.0, 0.0)
        assert got["line"][:3] == (3.0, 1.0, 5.0)
        assert got["line"][3] == pytest.approx(2.0, abs=1e-6)


def test_replicated_single_reading_has_slope_zero(spark, at):
    df = readings(spark, at, [(1, "x", "01:00", 5.0)] * 2)
    assert FT.time_series_long(df, ["stay"], "label", "t", "v").first().slope == 0.0


def test_wide_names_and_values(spark, at):
    rows = [(1, "Heart Rate", "01:00", 5.0), (2, "Alanine Aminotransferase (ALT)", "01:00", 7.0)]
    wide = FT.time_series_features(readings(spark, at, rows), ["stay"], "label", "t", "v")
    assert "mean_heart_rate" in wide.columns
    assert "slope_alanine_aminotransferase_(alt)" in wide.columns
    assert len(wide.columns) == 9
    got = {r.stay: r.asDict() for r in wide.collect()}
    assert got[1]["mean_heart_rate"] == 5.0 and got[1]["max_alanine_aminotransferase_(alt)"] is None
    assert got[2]["max_alanine_aminotransferase_(alt)"] == 7.0


def test_labels_with_dots_and_one_statistic(spark, at):
    long = FT.time_series_long(readings(spark, at, [(1, "P.a O2", "01:00", 5.0)]), ["stay"], "label", "t", "v")
    assert FT.pivot_features(long, ["stay"], "label").columns[1] == "mean_p.a_o2"
    only = FT.pivot_features(long, ["stay"], "label", stats=("mean",))
    assert only.first()["mean_p.a_o2"] == 5.0


def test_labels_that_clean_to_one_name_fail(spark, at):
    rows = [(1, "Heart Rate", "01:00", 5.0), (1, "heart rate", "01:00", 7.0)]
    with pytest.raises(ValueError, match="mean_heart_rate"):
        FT.time_series_features(readings(spark, at, rows), ["stay"], "label", "t", "v")


def test_merge_suffixes_and_rows(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "code STRING, stay INT")
    one = spark.createDataFrame([(1, 0.5, 1.0)], "stay INT, mean_glucose DOUBLE, v DOUBLE")
    two = spark.createDataFrame([(1, 0.7, 2.0)], "stay INT, mean_glucose DOUBLE, l DOUBLE")
    for size in (1 << 20, 0):
        merged = FT.merge_features(base, one, two, on=["stay"], max_bytes=size, sample=1.0)
        assert merged.columns == ["code", "stay", "mean_glucose_x", "v", "mean_glucose_y", "l"]
        assert sorted(tuple(r) for r in merged.collect() if r.stay == 1) == [
            ("a", 1, 0.5, 1.0, 0.7, 2.0), ("b", 1, 0.5, 1.0, 0.7, 2.0)]
        assert [tuple(r) for r in merged.collect() if r.stay == 2] == [("a", 2, None, None, None, None)]


def test_sparse_columns_boundary_is_strict_and_rows_complete(spark):
    rows = [(i, 1.0 if i < 4 else None, 1.0 if i < 9 else float("nan")) for i in range(5)]
    df = spark.createDataFrame(rows, "i INT, exact DOUBLE, full DOUBLE")
    assert {r.column_name: r.coverage for r in FT.column_coverage(df).collect()} == {"i": 1.0, "exact": 0.8, "full": 1.0}
    assert FT.drop_sparse_columns(df, 0.8).columns == ["i", "full"]
    assert FT.drop_sparse_complete(df, 0.79).count() == 4
    assert FT.drop_sparse_complete(df, 0.8, protect=["exact"]).count() == 4
    assert FT.drop_sparse_complete(df, 0.5, ignore=["exact"]).columns == ["i", "full"]


def test_same_result_under_any_partitioning(spark, at):
    rows = [(s, n, f"0{h}:00", float(s * h)) for s in range(20) for n in ("a", "b") for h in range(5)]
    df = readings(spark, at, rows)
    results = [
        sorted(tuple(round(x, 9) for x in r[2:]) for r in FT.time_series_long(df.repartition(p), ["stay"], "label", "t", "v").collect())
        for p in (1, 7)
    ]
    assert results[0] == results[1]


def test_complete_rows_with_odd_names(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "i INT, `mean_resp._rate` DOUBLE")
    assert [r.i for r in FT.complete_rows(df).collect()] == [1]
    assert FT.drop_sparse_complete(df, 0.3).columns == ["i", "mean_resp._rate"]


@pytest.mark.parametrize("micros", [1_000_000, 1_000, 10, 1])
def test_slopes_of_close_readings(spark, micros):
    """Without an origin times count from the entity's first reading."""
    rows = [(1, "x", datetime(2150, 1, 1, 10, 0, 0, 0), 1.0), (1, "x", datetime(2150, 1, 1, 10, 0, 0) + timedelta(microseconds=micros), 3.0)]
    slope = FT.time_series_long(spark.createDataFrame(rows, LONG), ["stay"], "label", "t", "v").first().slope
    assert slope == pytest.approx(2.0 / (micros / 3.6e9), rel=1e-9)


def test_features_count_from_the_start_of_the_stay(spark, at):
    from stayline.plans.features import build_features

    cohort = spark.createDataFrame([(1, at("2150-01-01 00:00")), (2, at("2150-01-02 00:00"))], "icustay_id INT, intime TIMESTAMP_NTZ")
    rows = [(s, "Resp. Rate", datetime(2150, 1, s, 1, 0, 0, m), float(m)) for s in (1, 2) for m in (0, 10, 20)]
    vitals = spark.createDataFrame(rows, "icustay_id INT, vitals_label STRING, charttime TIMESTAMP_NTZ, vitals_valuenum DOUBLE")
    labs = vitals.toDF("icustay_id", "labs_label", "charttime", "labs_valuenum")
    for base in (cohort, cohort.drop("intime")):
        got = build_features(base, vitals, labs).collect()
        assert [r["slope_resp._rate_x"] for r in got] == pytest.approx([3.6e9] * 2, rel=1e-5)


def test_coverage_reads_its_input_once(spark, at):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = io.StringIO()
    with redirect_stdout(out):
        FT.label_coverage(events, "event_type", "user_id").explain("formatted")
    # Both counts come from the stored pairs.
    assert "events.parquet" not in out.getvalue() and "MapInPandas" not in out.getvalue()
