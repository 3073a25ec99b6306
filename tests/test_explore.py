from stayline.operators import explore as E


def test_gender_and_age_filter(spark):
    df = spark.createDataFrame(
        [(1, 18, "M", 1, 0), (2, 89, "F", 2, 1), (3, 90, "F", 3, 1), (4, 17, "M", 4, 0)],
        "subject_id INT, age INT, gender STRING, icustay_id INT, mortality_30d INT",
    )
    assert sorted(r.subject_id for r in E.explore_cohort(df).collect()) == [1, 2]
    assert [r.subject_id for r in E.explore_cohort(df, "F").collect()] == [2]
    assert E.explore_cohort(df, listing=["age"]).columns == ["age"]
    assert E.subjects(df).count() == 4
    assert E.lookup_subjects(df, [2, 9]).count() == 1
    assert E.lookup_subjects(df, df.filter("age > 80")).count() == 2


def test_trend_series(spark, at):
    rows = [(1, "HEMOGLOBIN", at("2150-01-02"), 2.0), (1, "Hemoglobin", at("2150-01-01"), 1.0),
            (2, "Hemoglobin A1c", at("2150-01-01"), 5.0), (2, None, at("2150-01-01"), 6.0)]
    df = spark.createDataFrame(rows, "subject_id INT, label STRING, t TIMESTAMP_NTZ, v DOUBLE")
    exact = E.trend_series(df, "subject_id", "t", "v", "label", ["hemoglobin"])
    assert [r.v for r in exact.collect()] == [1.0, 2.0]
    part = E.trend_series(df, "subject_id", "t", "v", "label", ["GLOBIN A"], match="contains")
    assert [r.v for r in part.collect()] == [5.0]
    assert E.trend_series(df, "subject_id", "t", "v", "label", ["globin"], "contains", wanted=[2]).count() == 1


def test_input_ranges(spark):
    df = spark.createDataFrame([(1, 49.9, 20.0), (2, 50.0, 9.0), (3, None, 21.0)], "id INT, mean_glucose DOUBLE, mean_rdw DOUBLE")
    got = sorted((r.id, r.feature, r.value) for r in E.range_violations(df, ["id"]).collect())
    assert got == [(1, "mean_glucose", 49.9), (2, "mean_rdw", 9.0), (3, "mean_rdw", 21.0)]
    assert E.missing_info(["mean_rdw", "other"]) == ["other"]
    assert E.default_inputs(["mean_rdw", "other"]) == {"mean_rdw": 13.5, "other": 0.0}
