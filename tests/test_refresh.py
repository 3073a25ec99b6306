"""Stored parts of features, and events stored in buckets."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from stayline.operators.extract import window_extract, window_extract_stored
from stayline.operators.features import time_series_long
from stayline.operators.refresh import features_of_parts, merge_parts, refresh_features, series_parts
from stayline.sources import bucketed as B


def origin():
    return F.lit("2150-01-01").cast("timestamp_ntz")


def readings(spark, n=400):
    at = F.lit("2150-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=((F.col("id") * 37) % 2880).cast("int"))
    value = F.when(F.col("id") % 41 == 0, F.lit(None)).otherwise(1000.0 + (F.col("id") * F.col("id")) % 97 / 7)
    return spark.range(n).select(
        "id", (F.col("id") % 7).alias("stay"), F.when(F.col("id") % 53 > 0, F.concat(F.lit("l."), F.col("id") % 3)).alias("label"),
        at.alias("at"), value.alias("value"),
    )


def as_rows(df):
    return {(r["stay"], r["label"]): tuple(None if v is None else round(v, 7) for v in (r["mean"], r["min"], r["max"], r["slope"])) for r in df.collect()}


def test_parts_equal_one_pass(spark, tmp_path):
    rows = readings(spark)
    wanted = as_rows(time_series_long(rows, ["stay"], "label", "at", "value", origin()))
    assert len(wanted) == 21
    once = series_parts(rows, ["stay"], "label", "at", "value", origin())
    assert as_rows(features_of_parts(merge_parts(once, ["stay"], "label"), ["stay"], "label")) == wanted
    for k in range(4):
        got = refresh_features(spark, str(tmp_path / "p"), rows.filter(F.col("id") % 4 == k), ["stay"], "label", "at", "value", origin())
    assert as_rows(got) == wanted
    # A load without readings changes nothing.
    got = refresh_features(spark, str(tmp_path / "p"), rows.limit(0), ["stay"], "label", "at", "value", origin())
    assert as_rows(got) == wanted


def test_single_readings_and_equal_times(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a", "2150-01-01 05:00", 3.0), (2, "a", "2150-01-01 05:00", 3.0), (2, "a", "2150-01-01 05:00", 5.0)], "stay int, label string, at string, value double"
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    path = str(tmp_path / "p")
    for value in (3.0, 5.0):
        got = refresh_features(spark, path, rows.filter(F.col("value") == value), ["stay"], "label", "at", "value", origin())
    assert as_rows(got) == {(1, "a"): (3.0, 3.0, 3.0, None), (2, "a"): (4.0, 3.0, 5.0, 0.0)}


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_stored_events_are_not_shuffled(spark, tmp_path):
    events = readings(spark).withColumnRenamed("stay", "a b")
    starts = spark.createDataFrame([(i % 7, f"2150-01-0{1 + i % 2} 0{i % 9}:30") for i in range(20)], "`a b` long, start string")
    starts = starts.withColumn("start", F.col("start").cast("timestamp_ntz"))
    path = str(tmp_path / "stored")
    B.save_bucketed(events, path, ["a b"], "at", buckets=8, hours=12)
    stored, spec = B.read_bucketed(spark, path), B.bucket_spec(spark, path)
    wanted = window_extract(events, starts, ["a b"], "at", "start", "value", 12)
    for hours in (None, 5, 30):
        wanted = sorted(map(str, window_extract(events, starts, ["a b"], "at", "start", "value", hours or 12).collect()))
        for size in (0, 1 << 20):
            joined = window_extract_stored(stored, spec, starts, "start", "value", hours, max_bytes=size)
            assert sorted(str(r) for r in joined.select("a b", "id", "label", "at", "value", "start").collect()) == wanted
    assert len(wanted) > 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = explained(window_extract_stored(stored, spec, starts, "start", "value", max_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = text.split("\n\n")[0]
    assert "SortMergeJoin" in tree and tree.count("Exchange") == 1 and "Bucketed: true" in text
    # The only exchange is above the windows, below the join's other side.
    before = tree[: tree.index("Exchange")]
    assert "Scan parquet" in before


def test_stored_events_need_their_spec(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        B.read_bucketed(spark, str(tmp_path))
    with pytest.raises(ValueError):
        B.save_bucketed(readings(spark).withColumn(B.STRETCH, F.lit(1)), str(tmp_path / "x"), ["stay"], "at", 4)


def test_replaced_buckets_are_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    B.save_bucketed(readings(spark, 50), path, ["stay"], "at", 4)
    assert B.read_bucketed(spark, path).count() == 50
    B.save_bucketed(readings(spark, 70), path, ["stay"], "at", 2)
    assert B.read_bucketed(spark, path).count() == 70
