from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.functions import predicates as P
from stayline.functions import wording as W


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_code_range_takes_only_three_digit_codes_inside(spark):
    codes = ["1400", "2399", "1399", "2400", "V1000", "E9000", "14", None]
    df = frame(spark, [(c,) for c in codes], "c STRING")
    assert values(df.filter(P.code_in_range(F.col("c"), 140, 239)), "c") == ["1400", "2399"]


def test_matches_any_in_any_case(spark):
    df = frame(spark, [("Malignant x",), ("Old NEOPLASM of y",), ("Benign lesion",), (None,)], "t STRING")
    kept = values(df.filter(P.matches_any(F.col("t"), ["%malignant%", "%neoplasm%"])), "t")
    assert kept == ["Malignant x", "Old NEOPLASM of y"]


def test_stay_length_boundary(spark):
    start = datetime(2150, 1, 1, 10)
    ends = [start + timedelta(hours=48), start + timedelta(hours=48, seconds=1), None, start - timedelta(days=3)]
    df = frame(spark, [(i, start, e) for i, e in enumerate(ends)], "i INT, s TIMESTAMP_NTZ, e TIMESTAMP_NTZ")
    assert values(df.filter(P.lasts_at_most(F.col("s"), F.col("e"), 48)), "i") == [0, 3]


def test_age_uses_years_of_365_25_days(spark):
    at = datetime(2150, 6, 1, 12)
    seconds = [18 * P.YEAR_SECONDS, 18 * P.YEAR_SECONDS - 1, 89 * P.YEAR_SECONDS, 90 * P.YEAR_SECONDS, 300 * P.YEAR_SECONDS]
    df = frame(spark, [(at - timedelta(seconds=s), at) for s in seconds], "b TIMESTAMP_NTZ, a TIMESTAMP_NTZ")
    assert values(df, P.age_in_years(F.col("b"), F.col("a"))) == [18, 17, 89, 90, 300]


def test_outcome_counts_whole_days_and_earlier_events(spark):
    start = datetime(2150, 1, 1, 10)
    gaps = [timedelta(days=30, hours=23), timedelta(days=31), timedelta(days=-1), None]
    rows = [(start, None if g is None else start + g) for g in gaps]
    df = frame(spark, rows, "s TIMESTAMP_NTZ, e TIMESTAMP_NTZ")
    assert values(df, P.outcome_within_days(F.col("s"), F.col("e"), 30)) == [1, 0, 1, 0]


def test_window_includes_both_ends(spark):
    start = datetime(2150, 1, 1, 10)
    times = [start, start + timedelta(hours=48), start + timedelta(hours=48, seconds=1), start - timedelta(seconds=1), None]
    df = frame(spark, [(i, start, t) for i, t in enumerate(times)], "i INT, s TIMESTAMP_NTZ, t TIMESTAMP_NTZ")
    assert values(df.filter(P.in_window(F.col("t"), F.col("s"), 48)), "i") == [0, 1]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_gaps_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # A night with a clock change in New York.
        rows = [(datetime(2024, 3, 9, 12), datetime(2024, 3, 10, 12, 0, 0, 500000))]
        df = frame(spark, rows, "s TIMESTAMP_NTZ, e TIMESTAMP_NTZ")
        assert values(df, P.micros_between(F.col("s"), F.col("e"))) == [86_400_500_000]
        assert values(df, P.cut_to_day(F.col("e"))) == [datetime(2024, 3, 10)]
        assert values(df, P.micros_between(F.col("e"), F.col("s"))) == [-86_400_500_000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_risk_bands_and_direction_boundaries(spark):
    df = frame(spark, [(0.2,), (0.2000001,), (0.5,), (0.5000001,), (None,)], "p DOUBLE")
    assert values(df, W.risk_band(F.col("p"))) == ["low", "medium", "medium", "high", None]
    shap = frame(spark, [(0.0,), (0.1,), (-0.1,)], "s DOUBLE")
    assert values(shap, W.direction(F.col("s"))) == ["Decrease Risk", "Increase Risk", "Decrease Risk"]
    assert values(shap, W.signed_text(F.col("s"))) == ["+0.0000", "+0.1000", "-0.1000"]
    assert values(df, W.percent_text(F.col("p")))[0] == "20.00%"


def test_label_tests_ignore_case(spark):
    df = frame(spark, [("Mean BP",), ("heart rate",), (None,)], "l STRING")
    assert values(df.filter(P.equals_any_case(F.col("l"), "Heart Rate")), "l") == ["heart rate"]
    assert values(df.filter(P.contains_any_case(F.col("l"), "mean bp")), "l") == ["Mean BP"]
