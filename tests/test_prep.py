from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import prep as P


def test_hash_split_is_a_partition_and_repeats(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    first = P.hash_split(df, ["id"])
    again = P.hash_split(df.repartition(7), ["id"])
    test = {r.id for r in first.filter("is_test").collect()}
    assert test == {r.id for r in again.filter("is_test").collect()}
    train_rows, test_rows = P.split_parts(first)
    assert train_rows.count() + test_rows.count() == 2000
    assert abs(len(test) / 2000 - 0.2) < 0.03
    assert test != {r.id for r in P.hash_split(df, ["id"], seed=1).filter("is_test").collect()}


def test_stratified_split_is_exact_per_stratum(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") == 5, None).otherwise(0))
    for parts in (1, 5):
        split = P.hash_split(df.repartition(parts), ["id"], stratify_by="y")
        got = {r.y: (r.n, r.t) for r in split.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
        for y, (n, t) in got.items():
            assert t == (0 if y is None else ceil(0.2 * n))


def test_stratified_split_keeps_copies_of_a_key_together(spark):
    df = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("k"), F.lit(1).alias("y"))
    split = P.hash_split(df, ["k"], stratify_by="y")
    assert split.filter("k = 0").select("is_test").distinct().count() == 1
    assert split.count() == 300


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    n = 5000
    data = {
        "normal": rng.normal(size=n),
        "heavy": rng.standard_cauchy(n) ** 3,
        "ties": rng.integers(0, 4, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 1, n)),
        "two": np.where(np.arange(n) < n // 2, 1.0, 3.0),
    }
    rows = list(zip(*[[float(x) for x in column] for column in data.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} DOUBLE" for c in data)).repartition(4)
    for q in (0.5, 0.25):
        got = P.exact_quantiles(df, list(data), q)
        for name, column in data.items():
            assert got[name] == pytest.approx(np.quantile(column, q), rel=1e-12), name


def test_medians_skip_gaps_and_fill_test_rows(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (8.0, None), (None, None)], "a DOUBLE, b DOUBLE")
    medians = P.fit_medians(train)
    assert medians == {"a": 3.0, "b": None}
    test = spark.createDataFrame([(None, 1.0), (float("nan"), None), (2.0, None)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in P.apply_medians(test, medians).collect()] == [(3.0, 1.0), (3.0, None), (2.0, None)]
    assert P.fit_medians(train, ["a"], accuracy=1000) == {"a": 3.0}


def test_inference_uses_its_own_medians_or_given_ones(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 6.0)], "subject_id INT, a DOUBLE")
    own = P.prepare_for_inference(df)
    assert own.columns == ["a"] and sorted(r.a for r in own.collect()) == [2.0, 4.0, 6.0]
    assert sorted(r.a for r in P.prepare_for_inference(df, {"a": 9.0}).collect()) == [2.0, 6.0, 9.0]


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, c DOUBLE")
    scaler = P.fit_scaler(df, ["a", "c"])
    assert scaler == {"a": (2.0, 1.0), "c": (5.0, 1.0)}
    assert sorted(tuple(r) for r in P.scale_columns(df, scaler).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_one_hot_drops_the_first_level(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c d")], "i INT, s STRING")
    assert [tuple(r) for r in P.one_hot(df).orderBy("i").collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    assert P.one_hot(df, ["s"], drop_first=False).columns == ["i", "s_a", "s_b", "s_c d"]
    with pytest.raises(ValueError):
        P.column_levels(df, "s", max_levels=2)


def test_sample_is_reproducible_and_bounded(spark):
    df = spark.range(500)
    few = sorted(r.id for r in P.sample_rows(df, ["id"], 20).collect())
    assert len(few) == 20 and few == sorted(r.id for r in P.sample_rows(df.repartition(5), ["id"], 20).collect())
    assert P.sample_rows(df, ["id"], 1000).count() == 500
    copies = spark.range(100).select(F.lit(1).alias("id"))
    assert P.sample_rows(copies, ["id"], 20).count() == 20


def test_quantiles_of_infinities_ties_and_single_values(spark):
    inf = float("inf")
    data = {
        "up": [inf] * 7 + [1.0, 2.0, None],
        "down": [-inf] * 6 + [1.0, 2.0, None, float("nan")],
        "one": [5.0] + [None] * 9,
        "same": [4.0] * 10,
        "none": [None] * 10,
        "even": [1.0, 2.0, 3.0, 4.0, None, None, 5.0, 6.0, None, None],
    }
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` DOUBLE" for c in data)).repartition(3)
    got = P.exact_quantiles(df, list(data), 0.5)
    assert got == {"up": inf, "down": -inf, "one": 5.0, "same": 4.0, "none": None, "even": 3.5}


def test_sample_size_never_changes_the_choice(spark):
    df = spark.range(400)
    sizes = {n: {r.id for r in P.sample_rows(df.repartition(3), ["id"], n).collect()} for n in (1, 10, 399, 400, 401)}
    assert sizes[1] <= sizes[10] <= sizes[399] <= sizes[400] == sizes[401]
    assert [len(sizes[n]) for n in sorted(sizes)] == [1, 10, 399, 400, 400]
    assert P.sample_rows(df.limit(0), ["id"], 5).count() == 0
