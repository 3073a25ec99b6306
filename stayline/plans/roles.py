"""The sample tables in clinical roles: who plays patient, stay, diagnosis and measurement.

customer is the patient, an order the admission and stay (from order date to last ship date), a
line item a diagnosis, a part its dictionary entry, and an event a measurement.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators.cohort import first_per_key
from stayline.operators.extract import window_extract
from stayline.operators.features import time_series_features
from stayline.operators.joins import sized_join
from stayline.operators.scoring import LogisticModel
from stayline.operators.trees import Leaf
from stayline.plans.cohort import CohortRules, build_cohort
from stayline.sources.tables import materialize

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STAY_DAYS = 1800

RULES = CohortRules(
    code_range=(10, 20), title_patterns=["%gear%", "%anvil%"], max_hours=STAY_DAYS * 24, ages=(18, 89), outcome_days=30
)

# A fixed model on part features, given with its scaler.
PART_FEATURES = ["p_size", "p_retailprice", "name_length"]
PART_MODEL = LogisticModel(
    features=PART_FEATURES,
    weights=[0.8, -0.5, 0.3],
    intercept=-0.2,
    scaler={"p_size": (25.0, 14.0), "p_retailprice": (1400.0, 300.0), "name_length": (10.0, 2.0)},
)


# A few fixed leaves on the part features, in their order.
PART_LEAVES = [
    Leaf(0.7, {0: (-inf, 25.0), 1: (1200.0, inf)}),
    Leaf(-0.4, {0: (25.0, inf), 2: (-inf, 12.0)}),
    Leaf(0.25, {0: (10.0, 40.0), 1: (-inf, 1400.0), 2: (8.0, inf)}),
    Leaf(0.1, {}),
]

NEWTON_FEATURES = ["size", "is_english"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary: the brand number padded to three digits, then the part key, as code."""
    part = table(spark, folder, "part")
    number = F.lpad(F.regexp_extract("p_brand", "[0-9]+", 0), 3, "0")
    return part.select(
        "p_partkey",
        F.concat(number, F.lit("."), F.col("p_partkey").cast("string")).alias("icd9_code"),
        F.col("p_type").alias("short_title"),
        F.col("p_name").alias("long_title"),
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    codes = part_codes(spark, folder).select("p_partkey", "icd9_code")
    coded = sized_join(lines.withColumnRenamed("l_partkey", "p_partkey"), codes, ["p_partkey"])
    return coded.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"), "icd9_code"
    )


def stays(spark: SparkSession, folder: str) -> DataFrame:
    ends = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("outtime"))
    orders = table(spark, folder, "orders")
    return orders.join(ends, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderkey").alias("icustay_id"),
        F.col("o_orderdate").alias("intime"),
        "outtime",
    )


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
        F.col("o_orderpriority").alias("ethnicity"),
        F.col("o_orderstatus").alias("marital_status"),
        F.col("o_orderstatus").alias("insurance"),
        F.col("o_orderpriority").alias("admission_type"),
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """Birth from the balance; death is the first returned line of a large quantity, if any."""
    lines = table(spark, folder, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 30")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    deaths = (
        lines.select("l_orderkey", "l_shipdate")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.min("l_shipdate").alias("dod"))
    )
    days = F.floor(F.col("c_acctbal") * 3).cast("int")
    return (
        table(spark, folder, "customer")
        .join(deaths, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("subject_id"),
            F.col("c_mktsegment").alias("gender"),
            (F.lit("1925-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=days)).alias("dob"),
            "dod",
        )
    )


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    return build_cohort(
        patients(spark, folder),
        admissions(spark, folder),
        stays(spark, folder),
        diagnoses(spark, folder),
        part_codes(spark, folder).drop("p_partkey"),
        RULES,
    )


def first_events(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Start of the window: the first event of each user (or other key)."""
    keys = keys or ["user_id"]
    events = table(spark, folder, "events").select(*dict.fromkeys([*keys, "ts", "event_id"]))
    return first_per_key(events, keys, ["ts", "event_id"]).select(*keys, F.col("ts").alias("intime"))


def window_rows(
    spark: SparkSession,
    folder: str,
    keys: list[str] | None = None,
    granularity: str | None = None,
    hours: int = 48,
    **join_options,
) -> DataFrame:
    keys = keys or ["user_id"]
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    # Written once: both the size check and the join read the starts.
    starts = materialize(first_events(spark, folder, keys))
    return window_extract(
        events, starts, keys, "ts", "intime", "value", hours, granularity, **join_options
    ).select("event_id", "user_id", "event_type", "ts", "value", "intime")


def window_features(spark: SparkSession, folder: str) -> DataFrame:
    """Wide features of each user's first 48 hours."""
    return time_series_features(
        window_rows(spark, folder), ["user_id"], "event_type", "ts", "value", EVENT_TYPES, F.col("intime")
    )


def history_features(spark: SparkSession, folder: str) -> DataFrame:
    """Wide features of all event types over all time."""
    origin = F.lit("2024-01-01").cast("timestamp_ntz")
    events = table(spark, folder, "events")
    return time_series_features(events, ["user_id"], "event_type", "ts", "value", EVENT_TYPES, origin)


def part_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice",
        F.length("p_name").cast("double").alias("name_length"),
    )


def scaled_parts(spark: SparkSession, folder: str) -> DataFrame:
    return PART_MODEL.scale(part_features(spark, folder))


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    return table(spark, folder, "labels").join(documents, "doc_id")


def newton_features(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", F.log(F.col("n_chars") + 1.0).alias("size"), (F.col("lang") == "en").cast("double").alias("is_english")
    )
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return labels.join(documents, "doc_id").select(*NEWTON_FEATURES, "quality")


EMBEDDING_FEATURES = [f"e{i}" for i in range(64)]
VECTOR_MODEL = LogisticModel(features=EMBEDDING_FEATURES, weights=[(i % 7 - 3) / 4 for i in range(64)], intercept=0.1)


def embedding_features(spark: SparkSession, folder: str) -> DataFrame:
    """One column per vector position, and a 0/1 target from the label."""
    vectors = table(spark, folder, "embeddings")
    cells = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(EMBEDDING_FEATURES)]
    return vectors.select("vec_id", *cells, (F.col("label") >= 5).cast("int").alias("outcome"))
