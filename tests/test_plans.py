"""What the plans look like: scans pruned, dictionaries broadcast, no Python."""

import io
from contextlib import redirect_stdout

import pytest

from stayline.plans.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        REGISTRY[name](spark, FOLDER).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name", ["cohort_full", "extract_labs_window", "extract_vitals_window", "ts_features_wide", "contribution_table", "exact_shapley"]
)
def test_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "MapInPandas" not in text and "CartesianProduct" not in text


def test_window_join_reads_needed_columns_only_and_checks_the_window_in_the_join(spark):
    text = plan(spark, "ts_features_wide")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    assert "IsNotNull(value)" in text
    assert "Join condition: ((ts#" in text
    assert text.count("BroadcastHashJoin") >= 1 and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["linear_shap", "contribution_table", "exact_shapley", "logistic_score", "range_violations", "hash_split"])
def test_row_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_known_labels_reach_the_scan(spark):
    from stayline.operators.features import filter_high_coverage

    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    out = io.StringIO()
    with redirect_stdout(out):
        filter_high_coverage(events, "event_type", "user_id", 0.7, ["view", "click"]).explain("formatted")
    assert "In(event_type, [click,view])" in out.getvalue() or "In(event_type, [view,click])" in out.getvalue()
