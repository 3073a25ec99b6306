"""Feature build and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named
from stayline.operators import sparse as SP
from stayline.operators.columns import drop_leaky_columns, numeric_columns, select_final
from stayline.operators.explain import global_importance
from stayline.operators.features import (
    MAX_LABELS,
    complete_rows,
    drop_sparse_columns,
    drop_sparse_complete,
    filter_high_coverage,
    high_coverage_labels,
    merge_features,
    time_series_features,
    time_series_long,
)
from stayline.operators.joins import sized_join
from stayline.operators.prep import drop_missing_target, hash_split, split_parts
from stayline.operators.scoring import fit_boosted_trees
from stayline.operators.trees import tree_shap
from stayline.sources.tables import materialize

IDS = ["subject_id", "hadm_id", "icustay_id"]


def covered_features(
    readings: DataFrame,
    entity: str,
    label: str,
    time: str,
    value: str,
    min_coverage: float,
    labels: list[str] | None = None,
    starts: DataFrame | None = None,
    max_labels: int = MAX_LABELS,
) -> DataFrame:
    """Wide features of the labels that occur in enough entities.

    `starts` has one row per entity, with the time its slopes count from as its other column;
    without it they count from the entity's first reading.
    """
    if labels is None:
        labels = high_coverage_labels(readings, label, entity, min_coverage, max_labels)
    covered = filter_high_coverage(readings, label, entity, min_coverage, labels)
    origin = None
    if starts is not None:
        covered = sized_join(covered, starts.toDF(entity, "_start"), [entity], "left")
        origin = F.coalesce(F.col("_start"), col_named(time))
    return time_series_features(covered, [entity], label, time, value, labels, origin, max_labels)


def build_features(
    cohort: DataFrame,
    vitals: DataFrame,
    labs: DataFrame,
    stay: str = "icustay_id",
    vitals_coverage: float = 0.95,
    labs_coverage: float = 0.70,
    column_coverage: float = 0.8,
    path: str | None = None,
    start: str = "intime",
    max_labels: int = MAX_LABELS,
    **column_rules,
) -> DataFrame:
    """Cohort rows with the features of both measurement sets, sparse columns and rows dropped.

    Slopes count from the earliest `start` of a stay if the cohort has that column, else from its first
    reading. Every covered label becomes four columns; more than `max_labels` of them raise. Each feature set is written once, as the merge measures it before joining it; so are the merged
    rows (under `path`, or the shared work folder), which the column coverage and the result read.
    """
    starts = None
    if start in cohort.columns:
        starts = materialize(cohort.groupBy(col_named(stay)).agg(F.min(col_named(start)).alias("_start")))
    sets = [
        materialize(
            covered_features(
                readings, stay, f"{kind}_label", "charttime", f"{kind}_valuenum", coverage, starts=starts, max_labels=max_labels
            )
        )
        for readings, kind, coverage in ((vitals, "vitals", vitals_coverage), (labs, "labs", labs_coverage))
    ]
    merged = materialize(merge_features(cohort, *sets, on=[stay]), path)
    return drop_sparse_complete(merged, column_coverage, **column_rules)


def build_features_sparse(
    cohort: DataFrame,
    vitals: DataFrame,
    labs: DataFrame,
    stay: str = "icustay_id",
    vitals_coverage: float = 0.95,
    labs_coverage: float = 0.70,
    column_coverage: float = 0.8,
    path: str | None = None,
    start: str = "intime",
    max_features: int = MAX_LABELS,
    protect: list[str] | None = None,
    ignore: list[str] | None = None,
) -> DataFrame:
    """The rows of `build_features`, for any number of labels.

    Labels stay rows until the end: no list of them reaches the driver, and no plan has a column for each. A stay has one array of its filled
    features; coverage and complete rows are decided on the arrays, and only what is kept, at most the mean length of
    the arrays / `column_coverage`, becomes columns. More than `max_features` of these raise, and so does a kept feature with
    the name of a cohort column.
    """
    origin = None
    starts = None
    if start in cohort.columns:
        starts = materialize(cohort.groupBy(col_named(stay)).agg(F.min(col_named(start)).alias("_start")))
    sets = {}
    for readings, kind, coverage in ((vitals, "vitals", vitals_coverage), (labs, "labs", labs_coverage)):
        label, value = f"{kind}_label", f"{kind}_valuenum"
        covered = filter_high_coverage(readings, label, stay, coverage)
        if starts is not None:
            covered = sized_join(covered, starts, [stay], "left")
            origin = F.coalesce(F.col("_start"), F.col("charttime"))
        long = time_series_long(covered, [stay], label, "charttime", value, origin)
        sets[kind] = materialize(long.withColumnRenamed(label, "_label"))
    numbers = SP.number_labels(sets, "_label")
    arrays = materialize(SP.sparse_features(sets, stay, "_label", numbers))
    merged = materialize(SP.merge_sparse(cohort, arrays, [stay]), path)
    base = drop_sparse_columns(merged.drop(SP.FEATURES), column_coverage, protect, ignore).columns
    kept = SP.covered_names(merged, numbers, column_coverage, protect, ignore, max_features)
    narrow = SP.keep_features(merged.select(*[col_named(c) for c in base], SP.FEATURES), kept, complete=True)
    return SP.widen(complete_rows(narrow), kept, complete=True)


def rank_features(
    df: DataFrame,
    target: str = "mortality_30d",
    ids: list[str] | None = None,
    split_key: list[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    trees: int = 100,
    depth: int = 4,
    rate: float = 0.1,
) -> DataFrame:
    """Features by mean size of their boosted-tree attributions on the test rows."""
    ids = IDS if ids is None else ids
    key = ids if split_key is None else split_key
    usable, _ = drop_leaky_columns(drop_missing_target(df, target), target)
    features = [c for c in numeric_columns(usable) if c not in {*ids, *key, target}]
    narrow = usable.select(*[col_named(c) for c in dict.fromkeys([*key, *features, target])])
    # Fitting passes over the rows for every level of every tree: read them from files.
    marked = materialize(hash_split(narrow, key, test_size, seed, stratify_by=target))
    train, test = split_parts(marked)
    model = fit_boosted_trees(train, features, target, trees, depth, rate, seed)
    explained = tree_shap(test, model, features, key, background=train)
    return global_importance(explained)


def select_features(
    df: DataFrame,
    target: str = "mortality_30d",
    ids: list[str] | None = None,
    top_n: int = 10,
    keep: list[str] | None = None,
    **ranking,
) -> DataFrame:
    """Identifiers, the `top_n` features that matter most to the target, and the target."""
    ids = IDS if ids is None else ids
    top = rank_features(df, target, ids, **ranking).limit(top_n).collect()
    return select_final(df, ids, [row.feature for row in top], target, keep)
