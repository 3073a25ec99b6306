from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stayline.operators import features as FT
from stayline.operators import sparse as SP
from stayline.plans.features import build_features, build_features_sparse
from stayline.session import work_scope

COHORT = "icustay_id INT, intime TIMESTAMP_NTZ, age DOUBLE, note STRING"


def inputs(spark, at, vitals, labs, cohort):
    day = at("2150-01-01")
    rows = spark.createDataFrame([(s, day, a, n) for s, a, n in cohort], COHORT)
    sets = []
    for kind, readings in (("vitals", vitals), ("labs", labs)):
        schema = f"icustay_id INT, {kind}_label STRING, charttime TIMESTAMP_NTZ, {kind}_valuenum DOUBLE"
        sets.append(spark.createDataFrame([(s, n, at(f"2150-01-01 {h:02d}:00"), v) for s, n, h, v in readings], schema))
    return rows, *sets


def as_set(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def small(spark, at):
    vitals = [(s, "Heart Rate", h, float(s * h)) for s in range(1, 10) for h in range(3)]
    vitals += [(s, "pH.1", 1, None if s == 4 else float("nan") if s == 5 else 7.0) for s in range(1, 9)]
    vitals += [(s, "rare", 2, 1.0) for s in range(1, 4)] + [(None, "Heart Rate", 1, 1.0), (2, None, 1, 1.0)]
    labs = [(s, "Heart Rate", h, float(s + h)) for s in range(1, 9) for h in range(2)]
    cohort = [(s, 50.0 if s != 7 else None, None) for s in range(1, 11)] + [(1, 50.0, None), (None, 40.0, "x")]
    return inputs(spark, at, vitals, labs, cohort)


@pytest.mark.parametrize("rules", [{}, {"protect": ["note", "min_rare"]}, {"ignore": ["age", "slope_heart_rate_x"]}])
@pytest.mark.parametrize("least", [0.1, 0.5, 0.7, 0.95])
def test_arrays_give_the_rows_of_the_pivot(spark, at, least, rules):
    cohort, vitals, labs = small(spark, at)
    coverages = {"vitals_coverage": 0.2, "labs_coverage": 0.2, "column_coverage": least, **rules}
    wide = build_features(cohort, vitals, labs, **coverages)
    arrays = build_features_sparse(cohort, vitals, labs, **coverages)
    assert arrays.columns == wide.columns
    assert as_set(arrays) == as_set(wide)


def test_empty_tables_and_no_covered_label(spark, at):
    cohort, vitals, labs = small(spark, at)
    none = build_features_sparse(cohort, vitals.limit(0), labs.limit(0), column_coverage=0.5)
    assert none.columns == ["icustay_id", "intime", "age"]
    assert none.count() == 10  # all but the null stay and the null age
    assert build_features_sparse(cohort.limit(0), vitals, labs).count() == 0


def test_names_that_clash(spark, at):
    cohort, vitals, labs = small(spark, at)
    twice = vitals.unionByName(vitals.withColumn("vitals_label", F.lower("vitals_label")))
    with pytest.raises(ValueError, match="mean_heart_rate"):
        build_features_sparse(cohort, twice, labs, vitals_coverage=0.2)
    with pytest.raises(ValueError, match="named like columns"):
        build_features_sparse(cohort.withColumn("mean_heart_rate_x", F.lit(1.0)), vitals, labs, vitals_coverage=0.2, labs_coverage=0.2, column_coverage=0.5)
    with pytest.raises(ValueError, match="more than 2 features"):
        build_features_sparse(cohort, vitals, labs, vitals_coverage=0.2, labs_coverage=0.2, column_coverage=0.1, max_features=2)


def test_numbers_do_not_depend_on_the_partitions(spark):
    labels = spark.range(3000).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    seen = []
    for parts in (1, 7):
        numbers = SP.number_labels({"a": labels.repartition(parts), "b": labels.limit(5)}, "label").labels.collect()
        seen.append({(r.set, r.label): r.number for r in numbers})
    assert seen[0] == seen[1]
    assert sorted(seen[0].values()) == list(range(3005))
    assert [k for k, _ in sorted(seen[0].items(), key=lambda x: x[1])] == sorted(seen[0], key=lambda k: (k[1], k[0]))


def test_fifty_thousand_labels(spark):
    """Every label passes the first coverage; 200,000 features, of which ten labels' are kept."""
    stays = 40
    common = spark.range(10).withColumn("stay", F.explode(F.sequence(F.lit(0), F.lit(stays - 1))))
    rare = spark.range(50_000).withColumn("stay", (F.col("id") % stays).cast("int")).withColumn("id", F.col("id") + 10)
    readings = common.unionByName(rare).select(
        F.col("stay").alias("icustay_id"),
        F.concat(F.lit("lab "), F.col("id").cast("string")).alias("labs_label"),
        F.explode(F.array(*[F.lit(f"2150-01-01 0{h}:00").cast("timestamp_ntz") for h in (1, 2)])).alias("charttime"),
        (F.col("id") % 17 + F.hour("charttime")).cast("double").alias("labs_valuenum"),
    )
    vitals = readings.limit(0).withColumnsRenamed({"labs_label": "vitals_label", "labs_valuenum": "vitals_valuenum"})
    cohort = spark.range(stays).select(F.col("id").cast("int").alias("icustay_id"), F.lit("2150-01-01").cast("timestamp_ntz").alias("intime"))
    with work_scope(spark):
        got = build_features_sparse(cohort, vitals, readings, labs_coverage=0.0)
        assert len(got.columns) == 2 + 40
        rows = {r.icustay_id: r for r in got.collect()}
    assert len(rows) == stays
    for row in rows.values():
        assert [row[f"{s}_lab_3"] for s in FT.STATS] == pytest.approx([4.5, 4.0, 5.0, 1.0])


def test_rows_are_kept_without_a_shuffle(spark):
    kind = "array<struct<feature:bigint,value:double>>"
    rows = spark.createDataFrame([(1, [(0, 1.0), (3, 2.0)]), (2, [(3, 5.0)]), (3, [])], f"id INT, {SP.FEATURES} {kind}")
    kept = {3: "b", 0: "a"}
    whole = SP.widen(SP.keep_features(rows, kept, complete=True), kept, complete=True)
    assert [tuple(r) for r in whole.collect()] == [(1, 2.0, 1.0)]
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    loose = SP.widen(SP.keep_features(rows, kept), kept)
    assert sorted(map(tuple, loose.collect())) == [(1, 2.0, 1.0), (2, 5.0, None), (3, None, None)]
    shares = defaultdict(float, {r.feature: r.coverage for r in SP.feature_coverage(rows).collect()})
    assert shares[3] == pytest.approx(2 / 3) and shares[0] == pytest.approx(1 / 3)
