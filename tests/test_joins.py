from pyspark.sql import functions as F

from stayline.operators import joins as J


def frames(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500).cast("int").alias("k"),
        (F.col("id") % 7).cast("int").alias("v"),
    )
    small = spark.createDataFrame([(i, f"n{i}") for i in range(0, 400)] + [(1, "again")], "k INT, name STRING")
    return facts, small


def test_salted_join_equals_plain_join(spark):
    facts, small = frames(spark)
    assert J.hot_keys(facts, ["k"], 0.05, 1.0) == [(1,)]
    for how in ("inner", "left", "left_semi"):
        plain = facts.join(small, ["k"], how)
        salted = J.sized_join(facts, small, ["k"], how, max_bytes=0, sample=1.0, hot_share=0.05)
        assert salted.columns == plain.columns
        assert sorted(salted.collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_key_is_spread_over_tasks(spark):
    facts, small = frames(spark)
    # Exact copies: only few distinct rows, so the partition has to take part in the salt.
    hot = facts.filter("k = 1").withColumn("v", F.lit(0)).repartition(8)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = J.sized_join(hot, small, ["k"], max_bytes=0, sample=1.0)
        parts = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_keys_and_two_keys(spark):
    facts = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (None, 1, 7), (2, None, 8)], "a INT, b INT, v INT")
    small = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "a INT, b INT, n STRING")
    left = J.sized_join(facts, small, ["a", "b"], "left", max_bytes=0, sample=1.0)
    assert sorted((r.v, r.n) for r in left.collect()) == [(5, "x"), (6, "x"), (7, None), (8, None)]


def test_size_check(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "s STRING")
    assert J.table_bytes(df) == 2 * (16 + 8) + 3
    assert J.fits_broadcast(df) and not J.fits_broadcast(df, 10)
    assert J.table_bytes(df.select(F.array("s").alias("a"))) is None
