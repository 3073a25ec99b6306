"""Training, scoring and explaining with the logistic model."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named, has_number
from stayline.operators.columns import align_columns, drop_columns, drop_leaky_columns, is_empty, numeric_columns
from stayline.operators.explain import (
    beeswarm_table,
    contribution_table,
    global_importance,
    linear_shap,
    waterfall_table,
)
from stayline.operators.prep import (
    apply_medians,
    drop_missing_target,
    fit_medians,
    fit_scaler,
    hash_split,
    scale_columns,
    split_parts,
)
from stayline.operators.scoring import (
    PREDICTED_CLASS,
    PREDICTED_PROBABILITY,
    LogisticModel,
    append_score,
    classification_report,
    fit_logistic,
    roc_auc,
    score_logistic,
)
from stayline.sources.tables import materialize


@dataclass
class Training:
    model: LogisticModel
    report: DataFrame
    auc: DataFrame
    scored_test: DataFrame


def train_pipeline(
    df: DataFrame,
    target: str = "mortality_30d",
    split_key: list[str] | None = None,
    drop: list[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    stratify: bool = False,
    c: float = 1.0,
    max_iter: int = 1000,
) -> Training:
    """Split, impute, scale and fit; report on the test rows.

    Medians and scaler come from the train rows only. Rows are assigned to the test set by
    a hash of `split_key` (default: all columns, so a row decides alone).
    """
    if is_empty(df):
        raise ValueError("no rows to train on")
    key = df.columns if split_key is None else split_key
    known = drop_missing_target(df, target)
    marked = hash_split(known, key, test_size, seed, target if stratify else None)
    usable, _ = drop_leaky_columns(drop_columns(marked, drop), target)
    features = [n for n in numeric_columns(usable) if n != target]
    # Medians, moments and every iteration of the fit read these rows.
    rows = materialize(usable.select(*[col_named(n) for n in [*features, target, "is_test"]]))
    train, test = split_parts(rows)
    medians = fit_medians(train, features)
    filled = apply_medians(train, medians)
    scaler = fit_scaler(filled, features)
    model = fit_logistic(scale_columns(filled, scaler), features, target, c, max_iter)
    model.scaler, model.medians = scaler, medians
    # Both measures read the scores: write the three columns once.
    scored = materialize(
        score_logistic(scale_columns(apply_medians(test, medians), scaler), model).select(
            col_named(target), PREDICTED_CLASS, PREDICTED_PROBABILITY
        )
    )
    return Training(
        model,
        classification_report(scored, target, PREDICTED_CLASS),
        roc_auc(scored, target, PREDICTED_PROBABILITY),
        scored,
    )


def scaled_inputs(df: DataFrame, model: LogisticModel, ids: list[str]) -> DataFrame:
    """Ids and the model's features, aligned by name and scaled; gaps stay null."""
    return model.scale(align_columns(df, model.features, keep=ids))


def score_pipeline(df: DataFrame, model: LogisticModel, gaps: Observation | None = None) -> DataFrame:
    """All input columns plus class and probability; a row with a gap in a feature gets nulls.

    One projection over the input. `gaps` counts the missing values of every feature in the same
    pass: read `gaps.get` after an action on the result, or hand it to `warn_of_gaps`.
    """
    if gaps is not None:
        present = set(df.columns)
        counts = [
            F.count_if(~has_number(col_named(f).cast("double"))) if f in present else F.count(F.lit(1))
            for f in model.features
        ]
        df = df.observe(gaps, *[count.alias(f) for count, f in zip(counts, model.features)])
    present = set(df.columns)
    scaled = {
        f: (col_named(f) - F.lit(model.scaler[f][0])) / F.lit(model.scaler[f][1])
        if f in present
        else F.lit(None).cast("double")
        for f in model.features
    }
    return append_score(df, model.margin(scaled))


def warn_of_gaps(gaps: Observation) -> list[str]:
    """Features with missing values among the rows that were scored."""
    names = sorted(name for name, count in gaps.get.items() if count)
    if names:
        warnings.warn(f"missing values in {names}", stacklevel=2)
    return names


def explain(df: DataFrame, model: LogisticModel, ids: list[str], top_n: int = 10) -> dict[str, DataFrame]:
    """The tables behind the explanation pages, for rows with raw features."""
    explained = linear_shap(scaled_inputs(df, model, ids), model, ids)
    return {
        "contributions": contribution_table(explained),
        "waterfall": waterfall_table(explained, ids, top_n),
        "importance": global_importance(explained),
        "beeswarm": beeswarm_table(explained),
    }
