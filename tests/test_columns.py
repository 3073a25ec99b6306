import warnings

import pytest

from stayline.operators import columns as C


def test_drop_columns_tolerates_absent_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "subject_id INT, x DOUBLE")
    assert C.drop_columns(df).columns == ["x"]
    assert C.drop_columns(df, ["nothing"]).columns == ["subject_id", "x"]


def test_numeric_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i INT, x DOUBLE, s STRING, b BOOLEAN")
    assert C.numeric_columns(df) == ["i", "x"]
    assert C.keep_numeric(df).columns == ["i", "x"]


def test_align_orders_and_fills(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id INT, b DOUBLE, a DOUBLE")
    assert tuple(C.align_columns(df, ["a", "b", "c"], keep=["id"]).first()) == (1, None, 2.0, None)
    assert tuple(C.align_columns(df, ["c", "b", "a"], fill=0.0).first()) == (0.0, 2.0, None)


def test_leaky_names_are_dropped_and_target_kept(spark):
    leaking = spark.createDataFrame([(0.1, 0.9, 0)], "feature_1 DOUBLE, Mortality_30d_prob DOUBLE, mortality_30d INT")
    with pytest.warns(UserWarning, match="Mortality_30d_prob"):
        kept, leaks = C.drop_leaky_columns(leaking)
    assert kept.columns == ["feature_1", "mortality_30d"] and leaks == ["Mortality_30d_prob"]
    clean = spark.createDataFrame([(1, 3, 0)], "feature_1 INT, feature_2 INT, mortality_30d INT")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert C.drop_leaky_columns(clean)[0].columns == clean.columns
    assert C.leaky_columns(["MORTALITY_30D", "mortality_30d"], "mortality_30d") == ["MORTALITY_30D"]


def test_null_report_counts_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (None, 1.0), (None, None)], "i INT, x DOUBLE")
    assert {r.column_name: r.n_missing for r in C.null_report(df).collect()} == {"i": 2, "x": 2}


def test_is_empty_and_final_columns(spark):
    df = spark.createDataFrame([(1, 0.5, 0.7, "F", 1)], "subject_id INT, a DOUBLE, b DOUBLE, gender STRING, y INT")
    assert not C.is_empty(df) and C.is_empty(df.limit(0))
    assert C.select_final(df, ["subject_id"], ["b"], "y").columns == ["subject_id", "b", "y"]
    assert C.select_final(df, ["subject_id"], ["b"], "y", keep=["gender", "b"]).columns == ["subject_id", "b", "gender", "y"]
