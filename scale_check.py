"""Growth and skew on made-larger tables: python scale_check.py [folder] [factor ...].

Each factor copies the rows with shifted keys; "hot" variants then give a third of the events to one
user. Prints seconds for the window join with features, on both join paths, for coverage, and for the
cohort, the laboratory extract and the whole feature build on copies of all their tables.
"""

import sys
import time

from pyspark.sql import functions as F

from stayline.operators.cohort import first_per_key
from stayline.operators.extract import window_extract
from stayline.operators.features import high_coverage_labels, time_series_features
from stayline.plans.queries import REGISTRY
from stayline.plans.roles import EVENT_TYPES
from stayline.session import build_session, work_path
from stayline.sources.tables import materialize


def enlarged(spark, folder, factor, hot):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value")
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    shifted = copies.select(
        (F.col("event_id") * factor + F.col("copy")).alias("event_id"),
        (F.col("user_id") * factor + F.col("copy")).alias("user_id"),
        "event_type", "ts", "value",
    )
    if hot:
        shifted = shifted.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    return materialize(shifted.repartition(16), work_path(spark, f"events-x{factor}"))


KEYS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey"],
    "events": ["event_id", "user_id"],
    "part": [],
    "nation": [],
}
GROWN = ("cohort_full", "extract_labs_window", "build_features_full")


def enlarged_tables(spark, folder, factor):
    """A folder with `factor` copies of every table that has keys to shift."""
    target = work_path(spark, f"tables-x{factor}")
    for name, keys in KEYS.items():
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        if keys:
            copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
            df = copies.withColumns({k: F.col(k) * factor + F.col("copy") for k in keys}).drop("copy").repartition(16)
        df.write.parquet(f"{target}/{name}.parquet")
    return target


def features(events, **join):
    starts = materialize(
        first_per_key(events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("ts").alias("intime"))
    )
    rows = window_extract(events, starts, ["user_id"], "ts", "intime", "value", 48, **join)
    return time_series_features(rows, ["user_id"], "event_type", "ts", "value", EVENT_TYPES, F.col("intime"))


def clock(action):
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    factors = [int(a) for a in sys.argv[2:]] or [1, 10, 100]
    spark = build_session(app="scale", partitions=16)
    noop(features(enlarged(spark, folder, 1, False)))
    for factor in factors:
        for hot in (False, True):
            events = enlarged(spark, folder, factor, hot)
            line = [f"x{factor} {'hot' if hot else 'even'} rows={events.count()}"]
            line.append(f"broadcast {clock(lambda: noop(features(events))):.1f} s")
            line.append(f"salted {clock(lambda: noop(features(events, max_bytes=0))):.1f} s")
            coverage = clock(lambda: high_coverage_labels(events, "event_type", "user_id", 0.5))
            line.append(f"coverage {coverage:.1f} s")
            print(", ".join(line), flush=True)
        larger = enlarged_tables(spark, folder, factor)
        times = [f"{name} {clock(lambda: noop(REGISTRY[name](spark, larger))):.1f} s" for name in GROWN]
        print(f"x{factor} " + ", ".join(times), flush=True)


if __name__ == "__main__":
    main()
