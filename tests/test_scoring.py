import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stayline.operators import prep as P
from stayline.operators import scoring as S
from stayline.plans.modelling import explain, score_pipeline, train_pipeline, warn_of_gaps


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1.0, 10.0, 0.1] + [0.0, 50.0, 1.0]
    y = (x[:, 0] + (x[:, 1] - 50) / 10 + rng.normal(size=400) > 0).astype(int)
    rows = [(i, float(a), None if i % 40 == 3 else float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "subject_id INT, a DOUBLE, b DOUBLE, c DOUBLE, mortality_30d INT")


def test_fit_is_at_the_optimum_of_the_penalised_loss(data):
    rows = P.apply_medians(data, P.fit_medians(data, ["a", "b", "c"]))
    scaled = P.scale_columns(rows, P.fit_scaler(rows, ["a", "b", "c"]))
    model = S.fit_logistic(scaled, ["a", "b", "c"], "mortality_30d", tol=1e-10)
    table = scaled.select("a", "b", "c", "mortality_30d").toPandas().to_numpy()
    x, y, w = table[:, :3], table[:, 3], np.array(model.weights)
    residual = 1 / (1 + np.exp(-(x @ w + model.intercept))) - y
    assert np.abs(x.T @ residual + w).max() < 1e-3
    assert abs(residual.sum()) < 1e-3


def test_score_is_the_logistic_of_the_margin_and_null_with_a_gap(spark):
    model = S.LogisticModel(["a", "b"], [1.0, -2.0], 0.5)
    df = spark.createDataFrame([(1.0, 0.75), (0.0, 0.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    got = [(r.predicted_mortality_30d, r.predicted_probability) for r in S.score_logistic(df, model).collect()]
    assert got[0] == (0, 0.5) and got[1][0] == 1 and got[2] == (None, None)
    assert got[1][1] == pytest.approx(1 / (1 + np.exp(-0.5)))
    assert dict(S.score_logistic(df, model).dtypes)["predicted_mortality_30d"] == "bigint"


def test_model_round_trip(spark, tmp_path):
    model = S.LogisticModel(["b", "a"], [1.0, 2.0], 3.0, {"a": (0.0, 1.0), "b": (2.0, 3.0)}, {"a": 1.0, "b": 4.0})
    model.save(spark, str(tmp_path / "m"))
    assert S.LogisticModel.load(spark, str(tmp_path / "m")) == model
    with pytest.raises(Exception):
        S.LogisticModel.load(spark, str(tmp_path / "absent"))


def test_report_against_hand_counts(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4 + [(None, 1)], "y INT, p INT")
    got = {r["class"]: (r.precision, r.recall, r.f1_score, r.support) for r in S.classification_report(df, "y", "p").collect()}
    assert got["1"] == pytest.approx((3 / 5, 3 / 4, 2 / 3, 4))
    assert got["0"] == pytest.approx((4 / 5, 4 / 6, 8 / 11, 6))
    assert got["accuracy"] == pytest.approx((0.7, 0.7, 0.7, 10))
    assert got["macro avg"][0] == pytest.approx(0.7)
    assert got["weighted avg"][1] == pytest.approx((4 * 3 / 4 + 6 * 4 / 6) / 10)


@pytest.mark.parametrize("bins", [3, 1000])
def test_auc_counts_pairs(spark, bins):
    rng = np.random.default_rng(1)
    score = np.round(rng.normal(size=300), 1)
    score[:100] = 0.3
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)], "s DOUBLE, y INT").repartition(5)
    pos, neg = score[y == 1], score[y == 0]
    wanted = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    row = S.roc_auc(df, "y", "s", bins).first()
    assert row.auc == pytest.approx(wanted, abs=1e-12) and (row.pos, row.neg) == (len(pos), len(neg))
    assert S.roc_auc(df.filter("y = 1"), "y", "s").first().auc is None
    assert S.roc_auc(df.filter("y = 3"), "y", "s").first().auc is None


def test_training_scoring_and_explaining_agree(spark, data):
    trained = train_pipeline(data, split_key=["subject_id"])
    assert trained.model.features == ["a", "b", "c"] and set(trained.model.medians) == {"a", "b", "c"}
    assert trained.auc.first().auc > 0.7
    assert {"0", "1", "accuracy", "macro avg", "weighted avg"} == {r["class"] for r in trained.report.collect()}
    gaps = Observation("gaps")
    scored = score_pipeline(data, trained.model, gaps)
    assert scored.columns == data.columns + ["predicted_mortality_30d", "predicted_probability"]
    assert scored.filter("predicted_probability IS NULL").count() == 10
    with pytest.warns(UserWarning, match="'b'"):
        assert warn_of_gaps(gaps) == ["b"]
    scored = score_pipeline(data, trained.model)
    without = score_pipeline(data.drop("a"), trained.model)
    assert without.filter("predicted_probability IS NOT NULL").isEmpty()
    tables = explain(data, trained.model, ["subject_id"], top_n=3)
    assert tables["waterfall"].count() == 9
    sums = tables["contributions"].groupBy("subject_id", "base_value").agg(F.sum("shap").alias("s"))
    joined = sums.join(scored.dropna(), "subject_id").withColumn("p", S.logistic(F.col("base_value") + F.col("s")))
    worst = joined.agg(F.max(F.abs(F.col("p") - F.col("predicted_probability"))).alias("m")).first().m
    assert worst < 1e-12
    with pytest.raises(ValueError):
        train_pipeline(data.limit(0))


def test_filter_on_the_score_of_many_features_plans_quickly(spark):
    """Wide scores behind a filter must not blow up the optimizer."""
    names = [f"f{i}" for i in range(80)]
    df = spark.range(10).select(*[F.rand(i).alias(n) for i, n in enumerate(names)])
    model = S.LogisticModel(names, [0.1] * 80, 0.0, {n: (0.5, 2.0) for n in names})
    assert score_pipeline(df, model).filter("predicted_mortality_30d = 1").count() >= 0
    scored = S.score_logistic(model.scale(df), model).select("predicted_mortality_30d", "predicted_probability")
    assert S.classification_report(scored, "predicted_mortality_30d", "predicted_mortality_30d").count() >= 4
