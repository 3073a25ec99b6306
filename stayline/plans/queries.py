"""The registered queries: every operator on the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stayline.functions.predicates import col_named, micros_between
from stayline.functions.wording import (
    DIRECTION_ARROW,
    DIRECTION_IMPACT,
    direction,
    fixed_text,
    percent_text,
    risk_band,
    signed_text,
)
from stayline.operators import columns as C
from stayline.operators import explain as X
from stayline.operators import explore as E
from stayline.operators import features as FT
from stayline.operators import prep as P
from stayline.operators import scoring as S
from stayline.operators import walks as WK
from stayline.operators.cohort import first_per_key, select_codes, short_stays
from stayline.operators.extract import window_extract, window_extract_stored, with_dictionary
from stayline.operators.refresh import refresh_features
from stayline.operators.trees import leaf_table, tree_shap
from stayline.plans import roles as R
from stayline.plans.cohort import extract_labs, extract_vitals
from stayline.plans.features import build_features, build_features_sparse, rank_features, select_features
from stayline.plans.modelling import explain, score_pipeline, train_pipeline
from stayline.session import work_path
from stayline.sources import bucketed as B
from stayline.sources import published as PB
from stayline.sources import tables as T
from stayline.sources.schemas import schema_of

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles to a fixed number of decimals, with no negative zero, for comparison."""
    return df.select(
        *[
            (F.round(col_named(f.name), other.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else col_named(f.name)
            for f in df.schema.fields
        ]
    )


def slopes_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, 6, **{c: 4 for c in df.columns if c.startswith("slope")})


def long_rounded(df: DataFrame) -> DataFrame:
    digits = F.when(F.col("feature").startswith("slope"), F.round("value", 4)).otherwise(F.round("value", 6))
    return df.withColumn("value", digits + F.lit(0.0))


# ---------------------------------------------------------------- sources


@query
def pk_violations(spark, folder):
    return T.key_violations(R.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query
def csv_roundtrip(spark, folder):
    orders = R.table(spark, folder, "orders")
    path = work_path(spark, "orders-csv")
    orders.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)
    return T.load_csv(spark, path, orders.schema)


@query
def parquet_roundtrip(spark, folder):
    events = R.table(spark, folder, "events")
    path = work_path(spark, "events")
    T.save_dataset(events, path)
    return T.read_or_empty(spark, path, events.schema)


@query
def sql_passthrough(spark, folder):
    views = {name: R.table(spark, folder, name) for name in ("customer", "nation", "region")}
    return T.run_sql(
        spark,
        """SELECT r_name, count(*) AS n_customers, round(max(c_acctbal), 6) AS max_balance
           FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
                JOIN {region} ON n_regionkey = r_regionkey
           GROUP BY r_name""",
        views,
    )


def _as_csv(df: DataFrame, name: str) -> str:
    path = work_path(df.sparkSession, name)
    fit = df.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(name).fields])
    fit.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("escape", '"').csv(path, header=True)
    return path


def _in_schema(df: DataFrame, name: str) -> DataFrame:
    """The columns of a base table; those that the frame lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(name).fields])


@query
def ingest_events(spark, folder):
    """Events as measurements: CSV, one load into the fixed schema, read back."""
    events = R.table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("icustay_id"), F.col("ts").alias("charttime"),
        F.col("event_type").alias("value"), F.col("value").alias("valuenum"),
    )
    path = _as_csv(_in_schema(events, "chartevents"), "chartevents")
    loaded = T.ingest_table(spark, path, "chartevents", work_path(spark, "ingested"))
    return loaded.select("row_id", "icustay_id", "charttime", "value", "valuenum")


def _base_tables(spark, folder) -> dict[str, DataFrame]:
    """Rows for each of the ten base tables, in some of its columns."""
    def chosen(name, **columns):
        return R.table(spark, folder, name).select(*[F.expr(e).alias(c) for c, e in columns.items()])

    return {
        "patients": chosen("customer", row_id="c_custkey", subject_id="c_custkey", gender="c_mktsegment"),
        "admissions": chosen(
            "orders", row_id="o_orderkey", subject_id="o_custkey", hadm_id="o_orderkey", admittime="o_orderdate",
            admission_type="o_orderpriority", marital_status="o_orderstatus", hospital_expire_flag="o_orderkey % 2",
        ),
        "icustays": chosen(
            "orders", row_id="o_orderkey", subject_id="o_custkey", icustay_id="o_orderkey", intime="o_orderdate", los="o_totalprice"
        ),
        "diagnoses_icd": chosen(
            "orders", row_id="o_orderkey", subject_id="o_custkey", hadm_id="o_orderkey", seq_num="o_orderkey % 7", icd9_code="o_orderpriority"
        ),
        "d_icd_diagnoses": chosen("part", row_id="p_partkey", icd9_code="p_brand", short_title="p_type", long_title="p_name"),
        "chartevents": chosen("events", row_id="event_id", icustay_id="user_id", charttime="ts", value="event_type", valuenum="value"),
        "d_items": chosen("nation", row_id="n_nationkey", itemid="n_nationkey", label="n_name"),
        "labevents": chosen("events", row_id="event_id", subject_id="user_id", charttime="ts", flag="event_type", valuenum="value"),
        "noteevents": chosen("documents", row_id="doc_id", category="lang", text="text"),
        "d_labitems": chosen("region", row_id="r_regionkey", itemid="r_regionkey", label="r_name"),
    }


@query
def base_schemas(spark, folder):
    """All ten base tables through CSV, the fixed schema and a checked load: filled and distinct values of each column."""
    counts = None
    for name, rows in _base_tables(spark, folder).items():
        loaded = PB.publish_csv(spark, _as_csv(_in_schema(rows, name), name), name, work_path(spark, name))
        parts = [
            loaded.select(col_named(c).alias("value")).groupBy("value").agg(F.count("value").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_filled"), F.count("value").alias("n_distinct"))
            .select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "n_filled", "n_distinct")
            for c in rows.columns
        ]
        part = reduce(DataFrame.unionByName, parts)
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query
def published_load(spark, folder):
    """Nations, then customers in two loads under one name; a load that repeats a key is refused and changes nothing."""
    path = work_path(spark, "published")
    customers = R.table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    PB.publish_table(customers.filter("c_custkey % 3 = 0"), path, ["c_custkey"], ["c_name"])
    PB.publish_table(customers, path, ["c_custkey"], ["c_name"])
    refused = False
    try:
        PB.publish_table(customers.unionByName(customers.filter("c_custkey % 7 = 0")), path, ["c_custkey"], ["c_name"])
    except PB.LoadError:
        refused = True
    return PB.read_published(spark, path).withColumn("refused", F.lit(refused))


@query
def names_and_inputs(spark, folder):
    """Feature names through their file, in order, with what the form says of them, and the three inputs through their folder."""
    labels = FT.high_coverage_labels(R.window_rows(spark, folder), "event_type", "user_id", 0.66)
    names = [FT.feature_name(stat, label) for label in labels for stat in FT.STATS] + ["max_bicarbonate"]
    path = work_path(spark, "names")
    T.save_names(spark, names, path)
    read = T.load_names(spark, path)
    unknown = set(E.missing_info(read))
    rows = [("name", i, n, n not in unknown) for i, n in enumerate(read)]
    inputs = work_path(spark, "inputs")
    for name, table in (("labs", "events"), ("vitals", "orders"), ("cohort", "customer")):
        T.save_dataset(R.table(spark, folder, table), f"{inputs}/{name}")
    out = spark.createDataFrame(rows, "kind string, place long, name string, known boolean")
    for name, df in sorted(T.load_inputs(spark, inputs).items()):
        out = out.unionByName(df.agg(F.lit("input").alias("kind"), F.count(F.lit(1)).alias("place"), F.lit(name).alias("name"), F.lit(True).alias("known")))
    return out


@query
def ingest_notes(spark, folder):
    """Documents as notes: texts with line breaks and quotes through CSV."""
    notes = R.table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("category"), F.col("source").alias("description"), "text"
    )
    path = _as_csv(_in_schema(notes, "noteevents"), "noteevents")
    loaded = T.ingest_table(spark, path, "noteevents", work_path(spark, "ingested"))
    return loaded.select("row_id", "category", "description", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---------------------------------------------------------------- cohort


@query
def dx_code_filter(spark, folder):
    codes = select_codes(
        R.part_codes(spark, folder), "icd9_code", "long_title", R.RULES.code_range, R.RULES.title_patterns
    )
    return (
        R.diagnoses(spark, folder)
        .join(codes.select("icd9_code", "short_title"), "icd9_code")
        .select("subject_id", "hadm_id", "icd9_code", "short_title")
        .distinct()
    )


@query
def first_stay(spark, folder):
    orders = R.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query
def short_stay(spark, folder):
    return short_stays(R.stays(spark, folder), "intime", "outtime", R.STAY_DAYS * 24)


@query
def cohort_full(spark, folder):
    return R.cohort(spark, folder)


# ---------------------------------------------------------------- windows


@query
def window_48h_entity_key(spark, folder):
    return R.window_rows(spark, folder)


@query
def window_48h_admission_key(spark, folder):
    return R.window_rows(spark, folder, ["user_id", "event_type"])


@query
def window_day_granularity(spark, folder):
    return R.window_rows(spark, folder, granularity="day")


@query
def window_salted(spark, folder):
    """The shuffled join with hot users spread, as beyond the size of a broadcast."""
    return R.window_rows(spark, folder, max_bytes=0, hot_share=0.0001, sample=1.0)


@query
def window_stored(spark, folder):
    """Events stored in buckets of user and time; only the windows are shuffled to them, as beyond the size of a broadcast."""
    events = R.table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    path = work_path(spark, "buckets")
    B.save_bucketed(events, path, ["user_id"], "ts", buckets=8)
    starts = T.materialize(R.first_events(spark, folder))
    rows = window_extract_stored(B.read_bucketed(spark, path), B.bucket_spec(spark, path), starts, "intime", "value", max_bytes=0)
    return rows.select("event_id", "user_id", "event_type", "ts", "value", "intime")


@query
def window_crowded(spark, folder):
    """A window per user and event type, met through time buckets."""
    events = R.table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    starts = T.materialize(
        R.first_events(spark, folder, ["user_id", "event_type"]).withColumnRenamed("event_type", "window_type")
    )
    rows = window_extract(events, starts, ["user_id"], "ts", "intime", "value", 48, crowded_key=1)
    return rows.select("event_id", "user_id", "event_type", "ts", "value", "intime", "window_type")


@query
def window_with_dictionary(spark, folder):
    nations = R.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("itemid"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("category")
    )
    customers = R.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("itemid")
    )
    rows = R.window_rows(spark, folder).join(customers, "user_id")
    return with_dictionary(rows, nations, ["itemid"]).select(
        "user_id", "event_id", "ts", "value", "itemid", "label", "category"
    )


def _lab_events(spark, folder):
    """Line items as lab values of their order."""
    orders = R.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        R.table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_linenumber").alias("itemid"),
            F.col("l_shipdate").alias("charttime"),
            F.col("l_extendedprice").alias("valuenum"),
            F.col("l_returnflag").alias("valueuom"),
            F.col("l_linestatus").alias("flag"),
        )
    )


@query
def extract_labs_window(spark, folder):
    items = R.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("itemid"),
        F.col("n_name").alias("label"),
        F.lit("Blood").alias("fluid"),
        F.col("n_regionkey").cast("string").alias("category"),
    )
    cohort = T.materialize(R.cohort(spark, folder))
    return extract_labs(_lab_events(spark, folder), cohort, items, hours=R.STAY_DAYS * 24)


def _user_cohort(spark, folder):
    """First 48 hours of each user, once per return flag on the user's orders (as codes)."""
    orders = R.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    codes = (
        R.table(spark, folder, "lineitem")
        .select("l_orderkey", "l_returnflag")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("subject_id"), F.col("l_returnflag").alias("icd9_code"))
        .distinct()
    )
    starts = R.first_events(spark, folder).withColumnRenamed("user_id", "subject_id")
    return starts.join(codes, "subject_id").select(
        "subject_id",
        F.col("subject_id").alias("hadm_id"),
        F.col("subject_id").alias("icustay_id"),
        "icd9_code",
        F.col("icd9_code").alias("short_title"),
        "intime",
    )


def _chart_events(spark, folder):
    events = R.table(spark, folder, "events")
    customers = R.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return events.join(customers, F.col("user_id") == F.col("c_custkey")).select(
        F.col("user_id").alias("icustay_id"),
        F.col("c_nationkey").alias("itemid"),
        F.col("ts").alias("charttime"),
        F.col("value").alias("valuenum"),
        F.col("event_type").alias("valueuom"),
    )


@query
def extract_vitals_window(spark, folder):
    items = R.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("itemid"),
        F.col("n_name").alias("label"),
        F.col("n_regionkey").cast("string").alias("category"),
        F.lit("metavision").alias("dbsource"),
    )
    cohort = T.materialize(_user_cohort(spark, folder))
    return extract_vitals(_chart_events(spark, folder), cohort, items)


# ---------------------------------------------------------------- features


@query
def features_refreshed(spark, folder):
    """The features of `ts_features_long` out of three loads, each taken into the stored parts of those before."""
    rows = T.materialize(R.window_rows(spark, folder))
    path = work_path(spark, "parts")
    for load in range(3):
        new = rows.filter(F.col("event_id") % 3 == load)
        features = refresh_features(spark, path, new, ["user_id"], "event_type", "ts", "value", F.col("intime"))
    return slopes_rounded(features)


@query
def label_coverage(spark, folder):
    return rounded(FT.label_coverage(R.window_rows(spark, folder), "event_type", "user_id"))


@query
def filter_high_coverage(spark, folder):
    rows = T.materialize(R.window_rows(spark, folder).select("event_id", "user_id", "event_type", "ts", "value"))
    labels = FT.high_coverage_labels(rows, "event_type", "user_id", 0.66)
    return FT.filter_high_coverage(rows, "event_type", "user_id", 0.66, labels)


@query
def ts_features_long(spark, folder):
    rows = R.window_rows(spark, folder)
    return slopes_rounded(
        FT.time_series_long(rows, ["user_id"], "event_type", "ts", "value", F.col("intime"))
    )


@query
def ts_features_wide(spark, folder):
    return slopes_rounded(R.window_features(spark, folder))


@query
def slope_close_times(spark, folder):
    """Readings of 2150 within a tenth of a second: slopes to six digits, as (digits, exponent)."""
    events = R.table(spark, folder, "events")
    second = F.floor(micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1_000_000) % 100_000
    close = F.lit("2150-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(second / 1_000_000).cast("decimal(18,6)"))
    long = FT.time_series_long(events.withColumn("ts", close), ["user_id"], "event_type", "ts", "value")
    exponent = F.when(F.col("slope") != 0, F.floor(F.log10(F.abs("slope")))).cast("long")
    digits = F.round(F.col("slope") / F.pow(F.lit(10.0), exponent), 6) + F.lit(0.0)
    return long.select("user_id", "event_type", digits.alias("digits"), exponent.alias("exponent"))


@query
def dotted_labels(spark, folder):
    """Labels with a dot and a blank through coverage, features, merge and the complete rows."""
    label = F.concat(F.lit("Resp. "), F.col("event_type"))
    rows = T.materialize(R.window_rows(spark, folder).withColumn("event_type", label))
    covered = FT.filter_high_coverage(rows, "event_type", "user_id", 0.66)
    wide = FT.time_series_features(covered, ["user_id"], "event_type", "ts", "value", origin=F.col("intime"))
    base = R.first_events(spark, folder).select("user_id")
    merged = T.materialize(FT.merge_features(base, T.materialize(wide), on=["user_id"]))
    complete = FT.drop_sparse_complete(merged, 0.6)
    return long_rounded(X.to_long(complete, ["user_id"], [c for c in complete.columns if c != "user_id"]))


def _merged(spark, folder, **join_options):
    """Customers with events, their window features and their history features."""
    events = R.table(spark, folder, "events").select(F.col("user_id").alias("c_custkey"))
    base = E.lookup_subjects(
        R.table(spark, folder, "customer").select("c_custkey", "c_acctbal"), events, "c_custkey"
    )
    sets = [
        T.materialize(features(spark, folder).withColumnRenamed("user_id", "c_custkey"))
        for features in (R.window_features, R.history_features)
    ]
    return FT.merge_features(base, *sets, on=["c_custkey"], **join_options)


@query
def merge_features(spark, folder):
    return slopes_rounded(_merged(spark, folder))


@query
def merge_salted(spark, folder):
    return slopes_rounded(_merged(spark, folder, max_bytes=0, hot_share=0.0001, sample=1.0))


@query
def column_coverage(spark, folder):
    return rounded(FT.column_coverage(_merged(spark, folder)))


@query
def drop_sparse_complete(spark, folder):
    complete = FT.drop_sparse_complete(T.materialize(_merged(spark, folder)), 0.7)
    features = [c for c in complete.columns if c != "c_custkey"]
    return long_rounded(X.to_long(complete, ["c_custkey"], features))


def _feature_inputs(spark, folder):
    cohort = T.materialize(_user_cohort(spark, folder))
    events = R.table(spark, folder, "events").select(F.col("user_id").alias("icustay_id"), "event_type", "ts", "value")
    rows = T.materialize(
        FT.sized_join(events, cohort.select("icustay_id", "icd9_code", "intime"), ["icustay_id"]).filter(
            F.col("ts").between(F.col("intime"), F.col("intime") + F.expr("interval 48 hours"))
        )
    )
    vital = F.col("event_type").isin("click", "signup", "view")
    vitals = rows.filter(vital).select(
        "icustay_id", F.col("event_type").alias("vitals_label"), F.col("ts").alias("charttime"),
        F.col("value").alias("vitals_valuenum"),
    )
    labs = rows.filter(~vital).select(
        "icustay_id", F.col("event_type").alias("labs_label"), F.col("ts").alias("charttime"),
        F.col("value").alias("labs_valuenum"),
    )
    return cohort, vitals, labs


@query
def build_features_full(spark, folder):
    cohort, vitals, labs = _feature_inputs(spark, folder)
    wide = build_features(cohort, vitals, labs, vitals_coverage=0.7, labs_coverage=0.65, column_coverage=0.6)
    features = [c for c in wide.columns if c.split("_")[0] in FT.STATS]
    return long_rounded(X.to_long(wide, ["icustay_id", "icd9_code"], features))


@query
def build_features_by_arrays(spark, folder):
    """The same rows, labels kept as arrays until the kept features are known."""
    cohort, vitals, labs = _feature_inputs(spark, folder)
    wide = build_features_sparse(cohort, vitals, labs, vitals_coverage=0.7, labs_coverage=0.65, column_coverage=0.6)
    features = [c for c in wide.columns if c.split("_")[0] in FT.STATS]
    return long_rounded(X.to_long(wide, ["icustay_id", "icd9_code"], features))


# ---------------------------------------------------------------- columns


@query
def align_columns(spark, folder):
    return C.align_columns(
        R.table(spark, folder, "customer"), ["c_acctbal", "c_absent", "c_nationkey"], 0.0, keep=["c_custkey"]
    )


@query
def drop_leaky(spark, folder):
    named = R.table(spark, folder, "customer").withColumns(
        {"segment": F.col("c_mktsegment"), "Segment_prob": F.col("c_acctbal") / 10000}
    )
    return C.drop_leaky_columns(named, "segment")[0]


@query
def drop_ids(spark, folder):
    return C.drop_columns(R.cohort(spark, folder)).distinct()


@query
def numeric_only(spark, folder):
    return C.keep_numeric(R.table(spark, folder, "customer"))


@query
def null_report(spark, folder):
    return C.null_report(_merged(spark, folder))


# ---------------------------------------------------------------- preparation


@query
def hash_split(spark, folder):
    return P.hash_split(R.table(spark, folder, "labels"), ["doc_id"])


@query
def stratified_split(spark, folder):
    return P.hash_split(R.table(spark, folder, "labels"), ["doc_id"], stratify_by="quality")


@query
def median_impute(spark, folder):
    wide = R.window_features(spark, folder).select("user_id", "mean_click", "mean_view", "min_error", "max_purchase")
    train, test = P.split_parts(P.hash_split(wide, ["user_id"]))
    medians = P.fit_medians(train, wide.columns[1:])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rounded(P.apply_medians(both, medians))


@query
def median_large(spark, folder):
    """Medians of all line items, digit by digit: the same way at every size."""
    lines = R.table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity", "l_discount")
    medians = P.exact_quantiles(lines, lines.columns)
    return rounded(lines.agg(*[F.lit(medians[c]).alias(c) for c in lines.columns]))


@query
def inference_impute(spark, folder):
    wide = R.window_features(spark, folder).select("user_id", "mean_click", "mean_signup", "max_view")
    return rounded(P.prepare_for_inference(wide, drop=["icustay_id", "hadm_id"]).drop("user_id").groupBy(
        "mean_click", "mean_signup", "max_view").agg(F.count(F.lit(1)).alias("n_rows")))


@query
def standardize(spark, folder):
    part = R.table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(P.scale_columns(part, P.fit_scaler(part, ["p_size", "p_retailprice"])))


@query
def one_hot(spark, folder):
    return P.one_hot(R.table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query
def sample_ties(spark, folder):
    """A sample by a key that many rows share."""
    lines = R.table(spark, folder, "lineitem").select("l_orderkey")
    return P.sample_rows(lines, ["l_orderkey"], 1000)


@query
def sample_n(spark, folder):
    return P.sample_rows(R.table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], 100)


# ---------------------------------------------------------------- scores


def _stationary(rows: DataFrame, model: S.LogisticModel, target: str, c: float = 1.0) -> bool:
    """The gradient of the penalised loss is zero in every weight and in the intercept."""
    error = model.probability() - col_named(target)
    sums = rows.agg(F.avg(error).alias("b"), F.count(F.lit(1)).alias("n"), *[F.avg(error * col_named(f)).alias(f"g{i}") for i, f in enumerate(model.features)]).first()
    slopes = [sums[f"g{i}"] + w / (sums["n"] * c) for i, w in enumerate(model.weights)]
    return max(abs(x) for x in [*slopes, sums["b"]]) < 1e-4


@query
def logistic_fit(spark, folder):
    """Every row with whether the fit on all of them is the optimum, and its class goes with its probability."""
    rows = R.embedding_features(spark, folder)
    scaled = T.materialize(P.scale_columns(rows, P.fit_scaler(rows, R.EMBEDDING_FEATURES)))
    model = S.fit_logistic(scaled, R.EMBEDDING_FEATURES, "outcome")
    scored = S.score_logistic(scaled, model)
    agrees = (F.col(S.PREDICTED_PROBABILITY) > 0.5).cast("long") == F.col(S.PREDICTED_CLASS)
    return scored.select("vec_id", "outcome", agrees.alias("class_fits"), F.lit(_stationary(scaled, model, "outcome")).alias("is_optimum"))


@query
def logistic_newton(spark, folder):
    """Coefficients of a fit of two features on all labelled documents."""
    rows = R.newton_features(spark, folder)
    scaled = T.materialize(P.scale_columns(rows, P.fit_scaler(rows, R.NEWTON_FEATURES)))
    model = S.fit_logistic(scaled, R.NEWTON_FEATURES, "quality", tol=1e-10)
    cells = [*zip(model.features, model.weights), ("intercept", model.intercept)]
    return scaled.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.inline(F.array(*[F.struct(F.lit(n).alias("term"), (F.round(F.lit(w), 3) + F.lit(0.0)).alias("weight")) for n, w in cells]))
    )


@query
def model_roundtrip(spark, folder):
    """Scores of a model that was saved and loaded again."""
    path = work_path(spark, "model")
    R.PART_MODEL.save(spark, path)
    model = S.LogisticModel.load(spark, path)
    scored = S.score_logistic(model.scale(R.part_features(spark, folder)), model)
    return rounded(scored.select("p_partkey", S.PREDICTED_CLASS, S.PREDICTED_PROBABILITY))


@query
def logistic_score(spark, folder):
    scored = S.score_logistic(R.scaled_parts(spark, folder), R.PART_MODEL)
    return rounded(scored.select("p_partkey", S.PREDICTED_CLASS, S.PREDICTED_PROBABILITY))


@query
def risk_bands(spark, folder):
    scored = S.score_logistic(R.scaled_parts(spark, folder), R.PART_MODEL)
    p = F.col(S.PREDICTED_PROBABILITY)
    return scored.select(
        "p_partkey",
        risk_band(p).alias("band"),
        percent_text(p).alias("risk_text"),
        signed_text(col_named("p_size")).alias("size_text"),
    )


@query
def score_parts(spark, folder):
    parts = R.part_features(spark, folder).withColumn("p_size", F.when(F.col("p_size") != 7, F.col("p_size")))
    return rounded(score_pipeline(parts, R.PART_MODEL))


@query
def classification_report(spark, folder):
    docs = R.labelled_documents(spark, folder).withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    return rounded(S.classification_report(docs, "quality", "guess"))


@query
def roc_auc(spark, folder):
    return rounded(S.roc_auc(R.labelled_documents(spark, folder), "quality", "n_chars"))


@query
def training_report(spark, folder):
    """Test rows of each class, and whether the measures of the report follow from the scores of the test rows."""
    trained = train_pipeline(R.embedding_features(spark, folder), "outcome", split_key=["vec_id"], drop=["vec_id"])
    test, p = trained.scored_test, F.col(S.PREDICTED_PROBABILITY)
    # The area again, from its definition as an average rank: ties share their ranks.
    ranks = test.groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("pos"))
    below = F.expr("sum(n) over (partition by 0 order by p) - n")
    sums = ranks.withColumn("below", below).agg(F.sum(F.expr("pos * (below + (n + 1) / 2)")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n")).first()
    area = (sums["r"] - sums["p"] * (sums["p"] + 1) / 2) / (sums["p"] * (sums["n"] - sums["p"]))
    area_fits = abs(trained.auc.first()["auc"] - area) < 1e-9
    hits = test.groupBy(F.col("outcome").cast("string").alias("class")).agg(F.avg((F.col(S.PREDICTED_CLASS) == F.col("outcome")).cast("int")).alias("share"))
    fits = F.abs(F.col("share") - F.col("recall")) < 1e-9
    return trained.report.join(hits, "class").select("class", "support", (fits & F.lit(area_fits)).alias("measures_fit"))


@query
def training_measures(spark, folder):
    """The report that `training_report` proves, as it is: the measures of each class on the test rows, and the area under the curve."""
    trained = train_pipeline(R.embedding_features(spark, folder), "outcome", split_key=["vec_id"], drop=["vec_id"])
    return trained.report.withColumn("auc", F.lit(trained.auc.first()["auc"]))


# ---------------------------------------------------------------- explanation


def _linear(spark, folder):
    return X.linear_shap(
        R.scaled_parts(spark, folder), R.PART_MODEL, ["p_partkey"], {"p_size": 0.1, "name_length": -0.2}
    )


@query
def to_long(spark, folder):
    return rounded(X.to_long(R.part_features(spark, folder), ["p_partkey"], R.PART_FEATURES))


@query
def linear_shap(spark, folder):
    return rounded(X.explode_contributions(_linear(spark, folder)))


@query
def raw_attributions(spark, folder):
    return rounded(X.raw_attributions(_linear(spark, folder), ["p_partkey"], R.PART_FEATURES))


@query
def contribution_table(spark, folder):
    return rounded(X.contribution_table(_linear(spark, folder)))


@query
def contribution_words(spark, folder):
    """The other wordings of a contribution, and its value as text."""
    arrows = X.contribution_table(_linear(spark, folder), DIRECTION_ARROW)
    return arrows.select(
        "p_partkey", "feature", F.col("direction").alias("arrow"),
        direction(F.col("shap"), DIRECTION_IMPACT).alias("impact"), fixed_text(F.round("value", 6), 6).alias("value_text"),
    )


@query
def top_rows(spark, folder):
    return rounded(X.top_rows(_linear(spark, folder), ["p_partkey"], 10).select("p_partkey", "base_value", "shap_total"))


@query
def waterfall(spark, folder):
    return rounded(X.waterfall_table(_linear(spark, folder), ["p_partkey"], 10))


@query
def global_importance(spark, folder):
    return rounded(X.global_importance(_linear(spark, folder)))


@query
def beeswarm(spark, folder):
    return rounded(X.beeswarm_table(_linear(spark, folder)))


def part_probability(values: dict[str, Column]) -> Column:
    """The black box of the exact attribution: the model's probability."""
    return R.PART_MODEL.probability(values)


@query
def exact_shapley(spark, folder):
    explained = X.exact_shapley(R.scaled_parts(spark, folder), R.PART_FEATURES, part_probability, ["p_partkey"])
    return rounded(X.explode_contributions(explained))


@query
def exact_shapley_batches(spark, folder):
    explained = X.exact_shapley_batches(
        R.scaled_parts(spark, folder), R.PART_FEATURES, R.PART_MODEL.predict, ["p_partkey"]
    )
    return rounded(X.explode_contributions(explained))


@query
def walk_shapley(spark, folder):
    """Attributions against all parts, binned; three features have six orders, so the values are exact and the errors 0."""
    binned = R.part_features(spark, folder).select(
        (F.floor(F.col("p_size") / 10) * 10.0).alias("p_size"),
        (F.floor(F.col("p_retailprice") / 500) * 500.0).alias("p_retailprice"),
        F.lit(10.0).alias("name_length"),
    )
    background = WK.weighted_background(R.PART_MODEL.scale(binned), R.PART_FEATURES)
    explained = WK.walk_shapley(R.scaled_parts(spark, folder), R.PART_FEATURES, R.PART_MODEL.predict, ["p_partkey"], background)
    return rounded(X.explode_contributions(explained))


@query
def walk_shapley_wide(spark, folder):
    """All 64 vector positions: the mean score over the background, the score of a row, and what the attributions add up to."""
    vectors = R.embedding_features(spark, folder)
    lowest = vectors.groupBy("outcome").agg(*[F.round(F.min(n), 1).alias(n) for n in R.EMBEDDING_FEATURES])
    background = WK.weighted_background(lowest, R.EMBEDDING_FEATURES)
    explained = WK.walk_shapley(vectors, R.EMBEDDING_FEATURES, R.VECTOR_MODEL.predict, ["vec_id"], background, pairs=4)
    added = F.aggregate("contributions", F.lit(0.0), lambda total, c: total + c["shap"])
    complete = F.forall("contributions", lambda c: c["error"] >= 0)
    return rounded(explained.select("vec_id", "base_value", (F.col("base_value") + added).alias("score"), complete.alias("has_errors")))


@query
def explain_tables(spark, folder):
    """All tables of an explanation, one under the other."""
    tables = explain(R.part_features(spark, folder), R.PART_MODEL, ["p_partkey"])
    none = F.lit(None).cast("bigint")
    parts = [
        tables["contributions"].select(F.lit("contributions").alias("kind"), "p_partkey", "feature", "shap", F.col("rank").alias("place")),
        tables["waterfall"].select(F.lit("waterfall"), "p_partkey", "feature", F.col("running_after"), F.col("rank")),
        tables["importance"].select(F.lit("importance"), none, "feature", "mean_abs_shap", none),
        tables["beeswarm"].select(F.lit("beeswarm"), "p_partkey", "feature", "shap", "feature_rank"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return rounded(whole.withColumnRenamed("shap", "amount"))


@query
def gbt_select_features(spark, folder):
    """Identifier and target of the selected table, and how many features it has."""
    kept = select_features(R.embedding_features(spark, folder), "outcome", ["vec_id"], top_n=10)
    known = [c for c in kept.columns if c in R.EMBEDDING_FEATURES]
    complete = F.lit(True)
    for name in known:
        complete = complete & col_named(name).isNotNull()
    return kept.select("vec_id", "outcome", F.lit(len(known)).alias("n_features"), complete.alias("complete"))


@query
def feature_ranking(spark, folder):
    """All features by the mean size of their tree attributions on the test rows: what `select_features` takes the first of."""
    return rank_features(R.embedding_features(spark, folder), "outcome", ["vec_id"], trees=20)


@query
def tree_shap_importance(spark, folder):
    """Every feature with its number of attributions, and whether all rows add up to the margin of their trees."""
    rows = T.materialize(P.hash_split(R.embedding_features(spark, folder), ["vec_id"], stratify_by="outcome"))
    train, test = P.split_parts(rows)
    model = S.fit_boosted_trees(train, R.EMBEDDING_FEATURES, "outcome", trees=20)
    explained = T.materialize(tree_shap(test, model, R.EMBEDDING_FEATURES, ["vec_id"], train))
    margins = model.transform(S.assemble(test, R.EMBEDDING_FEATURES)).select("vec_id", (2 * vector_to_array("rawPrediction")[1]).alias("margin"))
    total = explained.select("vec_id", (F.col("base_value") + X.shap_sum()).alias("total")).join(margins, "vec_id")
    gap = total.agg(F.max(F.abs(F.col("total") - F.col("margin")))).first()[0]
    flat = X.explode_contributions(explained)
    return flat.groupBy("feature").agg(F.count("shap").alias("n_rows")).withColumn("adds_up", F.lit(gap < 1e-9))


@query
def tree_shap_fixed(spark, folder):
    """Attributions of a few fixed leaves, against all parts as background."""
    parts = R.part_features(spark, folder)
    explained = tree_shap(parts, R.PART_LEAVES, R.PART_FEATURES, ["p_partkey"], parts)
    return rounded(X.explode_contributions(explained))


@query
def tree_split(spark, folder):
    """The one split of a tree of depth one, fitted on all line items."""
    rows = R.table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("line"), (F.col("l_returnflag") == "R").cast("int").alias("returned")
    )
    model = S.fit_boosted_trees(T.materialize(rows), ["line"], "returned", trees=1, depth=1)
    cells = [F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("low", "high", "margin"), (*leaf.bounds[0], leaf.value))]) for leaf in leaf_table(model, spark)]
    return rounded(rows.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(F.array(*cells))))


# ---------------------------------------------------------------- exploring


@query
def explore_cohort(spark, folder):
    return E.explore_cohort(R.cohort(spark, folder), "BUILDING", (30, 60))


@query
def distinct_subjects(spark, folder):
    return E.subjects(R.table(spark, folder, "orders"), "o_custkey")


@query
def patient_lookup(spark, folder):
    orders = R.table(spark, folder, "orders").withColumnRenamed("o_custkey", "subject_id")
    wanted = E.explore_cohort(R.cohort(spark, folder), "MACHINERY")
    return E.lookup_subjects(orders, wanted).select("subject_id", "o_orderkey", "o_orderdate", "o_totalprice")


@query
def trend_exact(spark, folder):
    return E.trend_series(
        R.table(spark, folder, "events"), "user_id", "ts", "value", "event_type", ["PURCHASE", "Error"]
    )


@query
def trend_contains(spark, folder):
    return E.trend_series(
        R.window_rows(spark, folder), "user_id", "ts", "value", "event_type", ["IGN", "ie"], match="contains"
    )


@query
def range_violations(spark, folder):
    info = {"p_size": ("Size", 5.0, 45.0, 20.0), "p_retailprice": ("Price", 950.0, 1800.0, 1000.0)}
    return E.range_violations(R.part_features(spark, folder), ["p_partkey"], info)
