import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayline.operators import prep as P
from stayline.operators import radix as RX


@given(st.lists(st.floats(allow_nan=False), min_size=1))
def test_keys_keep_the_order(values):
    keys = RX.order_keys(np.array(values))
    assert [RX.key_value(int(k)) for k in keys] == values
    assert np.array(values)[np.argsort(keys, kind="stable")].tolist() == sorted(values)
    assert len(set(keys.tolist())) == len(set(values))


def test_every_rank_of_small_columns(spark):
    columns = [[-0.0, 0.0, 5e-324, -5e-324, 1.0, float(np.nextafter(1.0, 2.0))], [3.0, 3.0, -1e308, None, 1e308, None]]
    df = spark.createDataFrame(list(zip(*columns)), "a DOUBLE, b DOUBLE").repartition(3)
    wanted = [(0, r) for r in range(6)] + [(1, r) for r in range(4)]
    got = RX.select_ranks(df, wanted, [6, 4])
    for column, values in enumerate(columns):
        ordered = sorted(v for v in values if v is not None)
        assert [got[column, r] for r in range(len(ordered))] == ordered
    with pytest.raises(ValueError):
        RX.select_ranks(df, [(1, 4)], [6, 4])


def jobs(spark, run):
    context = spark.sparkContext
    group = f"radix-{id(run)}"
    context.setJobGroup(group, "counted")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_hundreds_of_columns_take_as_many_jobs_as_one(spark):
    names = [f"c.{i}" for i in range(300)]
    df = spark.range(500).select(*[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)]).repartition(3)
    df = df.withColumn("c.0", F.when(F.rand(1) < 0.7, F.lit(2.0)).otherwise(F.col("`c.0`")))
    found = {}
    many = jobs(spark, lambda: found.update(P.exact_quantiles(df, names, 0.37)))
    one = jobs(spark, lambda: P.exact_quantiles(df, names[:1], 0.37))
    assert many == one
    for name, values in df.drop("c.0").toPandas().items():
        assert found[name] == pytest.approx(np.quantile(values, 0.37), rel=1e-12)


def test_no_rows_and_no_columns(spark):
    df = spark.createDataFrame([(None,)], "a DOUBLE")
    assert P.exact_quantiles(df, []) == {}
    assert P.exact_quantiles(df, ["a"]) == {"a": None}
    assert P.exact_quantiles(df.limit(0), ["a"]) == {"a": None}
