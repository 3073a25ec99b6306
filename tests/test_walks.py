import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import explain as X
from stayline.operators import scoring as S
from stayline.operators import walks as WK

TEN = [f"f{i}" for i in range(10)]
MODEL = S.LogisticModel(TEN, [0.3 * (i - 4) for i in range(10)], 0.1)


def table(spark, names, n, seed=3):
    values = np.random.default_rng(seed).normal(size=(n, len(names)))
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(values)], ["id", *names])


def crossed_score():
    """A score with interactions; made here so that it travels to the workers by value."""
    return lambda cells: np.tanh(cells[:, 0] * cells[:, 1] + cells[:, 2:].sum(axis=1) * cells[:, -1])


crossed = crossed_score()


def long(explained):
    return {(r.id, r.feature): r for r in X.explode_contributions(explained).collect()}


def test_all_orders_give_the_exact_values(spark):
    names = ["a", "b", "c"]
    df = table(spark, names, 30)
    walked = long(WK.walk_shapley(df, names, crossed, ["id"]))
    exact = long(X.exact_shapley_batches(df, names, crossed, ["id"]))
    assert walked.keys() == exact.keys()
    for key, r in walked.items():
        assert (r.shap, r.base_value) == pytest.approx((exact[key].shap, exact[key].base_value), abs=1e-12) and r.error == 0.0


def test_ten_features_within_the_stated_error(spark):
    df = table(spark, TEN, 40)
    exact = long(X.exact_shapley_batches(df, TEN, crossed, ["id"]))
    for pairs in (64, 512):
        walked = long(WK.walk_shapley(df, TEN, crossed, ["id"], pairs=pairs))
        off = np.array([abs(r.shap - exact[key].shap) / r.error for key, r in walked.items()])
        # One in twenty should lie beyond two standard errors. Few pairs can miss a step that matters on few walks only.
        assert (off < 2).mean() > 0.9
    assert off.max() < 4.5 and max(r.error for r in walked.values()) < 0.05


def test_sums_equal_score_minus_base_over_a_weighted_background(spark):
    names = [f"g{i}" for i in range(14)]
    df = table(spark, names, 25)
    rounded = df.select(*[F.round(F.col(n)).alias(n) for n in names])
    background = WK.weighted_background(rounded.union(rounded.limit(5)).union(rounded.selectExpr(*["cast(null as double)"] * 14)), names)
    rows, shares = background
    assert len(rows) == 25 and shares.sum() == pytest.approx(1) and sorted(np.round(shares * 30))[-5:] == [2] * 5
    base = float(crossed(rows) @ shares)
    for partitions in (1, 5):
        out = WK.walk_shapley(df.repartition(partitions), names, crossed, ["id"], background, pairs=4).collect()
        scores = {r[0]: crossed(np.array([r[1:]]))[0] for r in df.collect()}
        for r in out:
            assert r.base_value == pytest.approx(base, abs=1e-12)
            assert r.base_value + sum(c.shap for c in r.contributions) == pytest.approx(scores[r.id], abs=1e-12)


def test_repeated_background_rows_weigh_as_often(spark):
    names = ["a", "b", "c"]
    df = table(spark, names, 5)
    twice = WK.weighted_background(spark.createDataFrame([(0.0, 0.0, 0.0)] * 3 + [(1.0, 2.0, 3.0)], names), names)
    zero, other = (WK.weighted_background(spark.createDataFrame([b], names), names) for b in ((0.0, 0.0, 0.0), (1.0, 2.0, 3.0)))
    mixed, left, right = (long(WK.walk_shapley(df, names, crossed, ["id"], b)) for b in (twice, zero, other))
    for key, r in mixed.items():
        assert r.shap == pytest.approx(0.75 * left[key].shap + 0.25 * right[key].shap, abs=1e-12)


def test_bounds_and_odd_tables(spark):
    with pytest.raises(ValueError, match="more than 3"):
        WK.weighted_background(spark.range(4), ["id"], most=3)
    with pytest.raises(ValueError, match="no complete row"):
        WK.weighted_background(spark.range(4).selectExpr("cast('nan' as double) x"), ["x"])
    one = WK.walk_shapley(spark.range(2).withColumn("a.b", F.col("id") + 1.0), ["a.b"], lambda c: 2 * c[:, 0], ["id"])
    assert [[(c.feature, c.shap, c.error) for c in r.contributions] for r in one.orderBy("id").collect()] == [[("a.b", 2.0, 0.0)], [("a.b", 4.0, 0.0)]]
    assert WK.walk_shapley(table(spark, TEN, 3).limit(0), TEN, MODEL.predict, ["id"]).count() == 0
    orders = WK.drawn_orders(12, 5)
    assert orders.shape == (5, 2, 12) and (np.sort(orders, axis=2) == np.arange(12)).all() and (orders[:, 0] == orders[:, 1, ::-1]).all()
