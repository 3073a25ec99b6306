from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import explain as X
from stayline.operators import scoring as S
from stayline.operators import trees as TR
from stayline.plans.features import rank_features, select_features

MODEL = S.LogisticModel(["a", "b", "c"], [1.0, -2.0, 0.5], 0.25)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    table = [(i, *map(float, row)) for i, row in enumerate(rng.normal(size=(40, 3)))]
    return spark.createDataFrame(table, "id INT, a DOUBLE, b DOUBLE, c DOUBLE")


def sums(explained):
    return {r.id: r.base_value + r.s for r in explained.select("id", "base_value", X.shap_sum().alias("s")).collect()}


def test_linear_attributions_add_up(rows):
    means = X.background_means(rows, MODEL.features)
    margins = {r.id: r.m for r in rows.select("id", MODEL.margin().alias("m")).collect()}
    for background in (None, means):
        assert sums(X.linear_shap(rows, MODEL, ["id"], background)) == pytest.approx(margins)


def test_exact_equals_linear_on_a_linear_score(rows):
    baseline = {"a": 0.3, "b": -0.1, "c": 1.0}
    exact = X.exact_shapley(rows, MODEL.features, lambda v: MODEL.margin(v), ["id"], baseline)
    linear = X.linear_shap(rows, MODEL, ["id"], baseline)
    pairs = X.explode_contributions(exact).join(
        X.explode_contributions(linear).withColumnRenamed("shap", "other"), ["id", "feature"])
    assert pairs.agg(F.max(F.abs(F.col("shap") - F.col("other"))).alias("m")).first().m < 1e-12


def test_exact_is_additive_in_probability_space(rows):
    exact = X.exact_shapley(rows, MODEL.features, MODEL.probability, ["id"])
    wanted = {r.id: r.p for r in rows.select("id", MODEL.probability().alias("p")).collect()}
    assert sums(exact) == pytest.approx(wanted)
    with pytest.raises(ValueError):
        X.exact_shapley(rows, [f"f{i}" for i in range(11)], MODEL.probability, ["id"])


def test_exact_with_ten_features(spark):
    names = [f"f{i}" for i in range(10)]
    df = spark.range(3).select("id", *[(F.col("id") * i + 1.0).alias(n) for i, n in enumerate(names)])
    model = S.LogisticModel(names, [0.01 * (i - 4) for i in range(10)], 0.1)
    wanted = {r.id: r.p for r in df.select("id", model.probability().alias("p")).collect()}
    columns = X.exact_shapley(df, names, model.probability, ["id"])
    batches = X.exact_shapley_batches(df, names, model.predict, ["id"])
    assert sums(columns) == pytest.approx(wanted) and sums(batches) == pytest.approx(wanted)
    pairs = X.explode_contributions(columns).join(
        X.explode_contributions(batches).withColumnRenamed("shap", "other"), ["id", "feature"])
    assert pairs.count() == 30
    assert pairs.agg(F.max(F.abs(F.col("shap") - F.col("other"))).alias("m")).first().m < 1e-12


def test_contribution_table_ranks_by_size_then_name(spark):
    explained = spark.createDataFrame(
        [(1, 0.5, [("x", 1.0, -2.0), ("b", 2.0, 1.0), ("a", 3.0, 1.0), ("z", 4.0, 0.0)])],
        "id INT, base_value DOUBLE, contributions ARRAY<STRUCT<feature: STRING, value: DOUBLE, shap: DOUBLE>>",
    )
    got = [(r["rank"], r.feature, r.abs_shap, r.direction) for r in X.contribution_table(explained).collect()]
    assert got == [(1, "x", 2.0, "Decrease Risk"), (2, "a", 1.0, "Increase Risk"), (3, "b", 1.0, "Increase Risk"),
                   (4, "z", 0.0, "Decrease Risk")]
    steps = [(r.feature, r.running_before, r.running_after) for r in X.waterfall_table(explained, ["id"]).collect()]
    assert steps == [("x", 0.5, -1.5), ("a", -1.5, -0.5), ("b", -0.5, 0.5), ("z", 0.5, 0.5)]


def test_top_rows_use_the_signed_sum(spark):
    explained = spark.createDataFrame(
        [(i, 0.0, [("x", 1.0, float(s))]) for i, s in ((1, 2), (2, -5), (3, 1))],
        "id INT, base_value DOUBLE, contributions ARRAY<STRUCT<feature: STRING, value: DOUBLE, shap: DOUBLE>>",
    )
    assert [r.id for r in X.top_rows(explained, ["id"], 2).collect()] == [1, 3]


def test_global_views(rows):
    explained = X.linear_shap(rows, MODEL, ["id"])
    importance = X.global_importance(explained).collect()
    assert [r.feature for r in importance][0] == "b"
    assert X.global_importance(explained, 2).count() == 2
    ranks = X.beeswarm_table(explained).select("feature", "feature_rank").distinct().collect()
    assert {r.feature: r.feature_rank for r in ranks} == {r.feature: i + 1 for i, r in enumerate(importance)}
    assert X.raw_attributions(explained, ["id"], MODEL.features).columns == ["id", "a", "b", "c"]
    assert X.to_long(rows, ["id"], MODEL.features).count() == 120


def brute_force(score, row, background):
    """Average over orders and background rows of what each feature changes when it is switched on."""
    k = len(row)
    out = np.zeros(k)
    orders = list(permutations(range(k)))
    for other in background:
        for order in orders:
            current = other.copy()
            for i in order:
                before = score(current)
                current[i] = row[i]
                out[i] += score(current) - before
    return out / (len(background) * len(orders))


def test_tree_attributions_equal_brute_force(spark, rows):
    target = rows.withColumn("y", (F.col("a") * F.col("b") + F.col("c") > 0).cast("int"))
    model = S.fit_boosted_trees(target, ["a", "b", "c"], "y", trees=5, depth=3)
    leaves = TR.leaf_table(model, spark)

    def score(x):
        return sum(l.value for l in leaves if all(lo < x[f] <= hi for f, (lo, hi) in l.bounds.items()))

    table = rows.orderBy("id").toPandas().to_numpy()[:, 1:]
    # The leaves give the model's own margin: Spark's raw prediction is half the log-odds.
    scored = model.transform(S.assemble(target, ["a", "b", "c"]).withColumnRenamed("_features", model.getFeaturesCol()))
    margins = [2 * r.rawPrediction[1] for r in scored.orderBy("id").select("rawPrediction").collect()]
    assert [score(x) for x in table] == pytest.approx(margins)

    explained = TR.tree_shap(target, model, ["a", "b", "c"], ["id"], rows, ["id"], background_rows=7)
    background = TR.sample_rows(rows, ["id"], 7).toPandas().to_numpy()[:, 1:]
    got = {r.id: r for r in X.raw_attributions(explained, ["id"], ["a", "b", "c"]).collect()}
    for i in range(10):
        assert list(got[i])[1:] == pytest.approx(list(brute_force(score, table[i], background)), abs=1e-12)
    assert sums(explained) == pytest.approx({i: score(x) for i, x in enumerate(table)})


def test_feature_selection_finds_the_signal(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    rows = [(i, i, i, *map(float, r), int(r[2] > 0), 0.5, "t") for i, r in enumerate(x)]
    df = spark.createDataFrame(
        rows,
        """subject_id INT, hadm_id INT, icustay_id INT, n0 DOUBLE, n1 DOUBLE, signal DOUBLE, n3 DOUBLE,
           mortality_30d INT, mortality_30d_guess DOUBLE, note STRING""",
    )
    with pytest.warns(UserWarning, match="mortality_30d_guess"):
        ranked = rank_features(df, trees=4, depth=2).collect()
    assert ranked[0].feature == "signal" and len(ranked) == 4
    with pytest.warns(UserWarning):
        kept = select_features(df, top_n=1, keep=["note"], trees=4, depth=2)
    assert kept.columns == ["subject_id", "hadm_id", "icustay_id", "signal", "note", "mortality_30d"]
    assert kept.count() == 300


LEAVES = [
    TR.Leaf(0.7, {0: (-np.inf, 0.2), 1: (-0.3, np.inf)}),
    TR.Leaf(-0.4, {2: (0.0, np.inf)}),
    TR.Leaf(0.9, {0: (-1.0, 1.0), 1: (-np.inf, 0.5), 2: (-0.5, np.inf)}),
    TR.Leaf(0.3, {}),
]


def test_the_whole_background_counts_under_any_partitioning(spark, rows):
    def score(x):
        return sum(l.value for l in LEAVES if all(lo < x[f] <= hi for f, (lo, hi) in l.bounds.items()))

    table = rows.orderBy("id").toPandas().to_numpy()[:, 1:]
    results = []
    for parts in (1, 7):
        explained = TR.tree_shap(rows, LEAVES, ["a", "b", "c"], ["id"], rows.repartition(parts))
        got = {r.id: list(r)[1:] for r in X.raw_attributions(explained, ["id"], ["a", "b", "c"]).collect()}
        assert got[3] == pytest.approx(list(brute_force(score, table[3], table)), abs=1e-12)
        assert sums(explained) == pytest.approx({i: score(x) for i, x in enumerate(table)})
        results.append(got)
    assert results[0] == results[1]


def test_a_row_with_a_gap_gets_no_attribution(spark, rows):
    odd = spark.createDataFrame([(100, None, 0.1, 0.2), (101, 0.1, float("nan"), 0.2), (102, 0.1, 0.1, 0.2)], rows.schema)
    explained = TR.tree_shap(odd, LEAVES, ["a", "b", "c"], ["id"], rows.unionByName(odd))
    got = {r.id: list(r)[1:] for r in X.raw_attributions(explained, ["id"], ["a", "b", "c"]).collect()}
    assert got[100] == got[101] == [None] * 3 and None not in got[102]
    with pytest.raises(ValueError, match="complete rows"):
        TR.tree_shap(odd, LEAVES, ["a", "b", "c"], ["id"], odd.filter("id < 102"))


def test_names_with_dots(spark, rows):
    names = ["mean_resp._rate", "a.b", "c`d"]
    dotted = rows.toDF("row.id", *names)
    explained = TR.tree_shap(dotted, LEAVES, names, ["row.id"], dotted)
    assert [r.feature for r in X.global_importance(explained).collect()]
    model = S.LogisticModel(names, MODEL.weights, MODEL.intercept)
    batches = X.exact_shapley_batches(dotted, names, model.predict, ["row.id"])
    assert X.explode_contributions(batches).filter("shap is null").count() == 0
    wide = dotted.withColumn("mortality_30d", (F.col("`a.b`") > 0).cast("int")).withColumn("subject_id", F.col("`row.id`"))
    ranked = rank_features(wide, ids=["subject_id"], trees=2, depth=2)
    assert {r.feature for r in ranked.collect()} == {*names, "row.id"}


def test_width_is_an_argument(spark, rows):
    with pytest.raises(ValueError, match="at most 2"):
        X.exact_shapley(rows, ["a", "b", "c"], MODEL.probability, ["id"], max_features=2)


def test_to_long_without_features(spark):
    out = X.to_long(spark.createDataFrame([(1, 2.0)], "id long, x double"), ["id"], [])
    assert out.dtypes == [("id", "bigint"), ("feature", "string"), ("value", "double")] and out.count() == 0
