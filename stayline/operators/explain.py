"""Additive attributions of scores, and the tables made of them.

An explained frame has one row per scored row: its id columns, `base_value`, and
`contributions`, an array of (feature, value, shap) in feature order. All per-row work (ranking,
running sums, totals) happens inside the row, so it needs no shuffle; `explode_contributions`
gives the long form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stayline.functions.predicates import col_named
from stayline.functions.wording import DIRECTION_RISK, direction
from stayline.operators.joins import sized_join
from stayline.operators.scoring import LogisticModel
from stayline.session import ship_package
from stayline.sources.tables import materialize

#: Exact attribution takes 2^k scores per row; more features must be asked for.
MAX_EXACT_FEATURES = 10


def to_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One (feature, value) row per feature; without features there are no rows, of the same columns."""
    if not features:
        none = [F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value")]
        return df.select(*[col_named(c) for c in ids], *none).limit(0)
    doubled = df.select(*[col_named(c) for c in ids], *[col_named(f).cast("double").alias(f) for f in features])
    return doubled.unpivot([col_named(c) for c in ids], [col_named(f) for f in features], "feature", "value")


def background_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Column means of the background rows."""
    row = df.agg(*[F.avg(col_named(f)).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return {f: row[f"_{i}"] for i, f in enumerate(features)}


def explained_frame(df: DataFrame, ids: list[str], base: Column, parts: list[tuple[str, Column]]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            col_named(name).cast("double").alias("value"),
            shap.alias("shap"),
        )
        for name, shap in parts
    ]
    return df.select(*[col_named(c) for c in ids], base.alias("base_value"), F.array(*cells).alias("contributions"))


def linear_shap(
    df: DataFrame, model: LogisticModel, ids: list[str], background: Mapping[str, float] | None = None
) -> DataFrame:
    """Attributions of the log-odds of a linear model: weight * (value - background mean).

    Without a background the features are taken as scaled, that is with mean 0.
    """
    means = background or {}
    base = float(model.intercept)
    parts = []
    for name, weight in zip(model.features, model.weights):
        mean = float(means.get(name, 0.0))
        base += weight * mean
        parts.append((name, F.lit(float(weight)) * (col_named(name) - F.lit(mean))))
    return explained_frame(df, ids, F.lit(base), parts)


def exact_shapley(
    df: DataFrame,
    features: list[str],
    score: Callable[[dict[str, Column]], Column],
    ids: list[str],
    baseline: Mapping[str, float] | None = None,
    max_features: int = MAX_EXACT_FEATURES,
) -> DataFrame:
    """Shapley values of any score expression against one baseline row (zeros by default).

    `score` maps {feature: column} to a column. Each row scores every subset of features
    taken from the row, the others from the baseline, inside the row. The number of subsets is
    2^k, hence at most `max_features` features; beyond four or five `exact_shapley_batches` is faster.
    """
    k = len(features)
    _check_width(k, max_features)
    zeros = {f: 0.0 for f in features} | dict(baseline or {})
    # The values of a row as one array, so that the subset function reads plain array cells.
    given = F.array(*[col_named(f).cast("double") for f in features])

    def subset_score(subset: Column) -> Column:
        picked = {
            f: F.when(subset.bitwiseAND(1 << i) != 0, F.col("_x")[i]).otherwise(F.lit(float(zeros[f])))
            for i, f in enumerate(features)
        }
        return score(picked).cast("double")

    subsets = F.sequence(F.lit(0), F.lit(2**k - 1))
    scored = df.withColumn("_x", given).withColumn("_scores", F.transform(subsets, subset_score))
    parts = []
    for name, factors in zip(features, subset_weights(k)):
        products = F.zip_with(F.col("_scores"), F.lit(factors), lambda a, b: a * b)
        parts.append((name, F.aggregate(products, F.lit(0.0), lambda total, x: total + x)))
    return explained_frame(scored, ids, F.col("_scores")[0], parts)


def exact_shapley_batches(
    df: DataFrame,
    features: list[str],
    predict: Callable[[np.ndarray], np.ndarray],
    ids: list[str],
    baseline: Mapping[str, float] | None = None,
    max_features: int = MAX_EXACT_FEATURES,
) -> DataFrame:
    """`exact_shapley` for a black box that maps a (rows, features) array to scores.

    The rows stream through Arrow batches and the subsets of a few rows at a time are scored in
    one call: the choice for many features, where the column form evaluates 2^k lambdas per row.
    """
    k = len(features)
    _check_width(k, max_features)
    zeros = {f: 0.0 for f in features} | dict(baseline or {})
    base_row = np.array([float(zeros[f]) for f in features])
    ship_package(df.sparkSession)
    names = [f"_shap{i}" for i in range(k)]
    # Batches look columns up by name: plain ones inside, the given ones outside.
    inner = [f"_f{i}" for i in range(k)]
    rows = df.select(
        *[col_named(c).alias(f"_i{i}") for i, c in enumerate(ids)],
        *[col_named(f).cast("double").alias(n) for f, n in zip(features, inner)],
    )
    schema = StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in ["_base", *names]]])

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.array(subset_weights(k))
        switched_on = (np.arange(2**k)[:, None] >> np.arange(k)) & 1 == 1
        step = max(1, (1 << 20) // (2**k * k))
        base = float(predict(base_row[None, :])[0])
        for batch in batches:
            values = batch[inner].to_numpy(dtype=float)
            out = np.empty_like(values)
            for at in range(0, len(values), step):
                some = values[at : at + step]
                cells = np.where(switched_on[None], some[:, None, :], base_row)
                scores = predict(cells.reshape(-1, k)).reshape(len(some), -1)
                out[at : at + step] = scores @ weights.T
            result = pd.DataFrame(out, columns=names, index=batch.index)
            yield pd.concat([batch, result.assign(_base=base)], axis=1)[schema.fieldNames()]

    scored = rows.mapInPandas(attribute, schema).select(
        *[F.col(f"_i{i}").alias(c) for i, c in enumerate(ids)],
        *[F.col(n).alias(f) for f, n in zip(features, inner)],
        "_base",
        *names,
    )
    return explained_frame(scored, ids, F.col("_base"), [(f, F.col(n)) for f, n in zip(features, names)])


def subset_weights(k: int) -> list[list[float]]:
    """weights[i][subset]: factor of a subset's score in the Shapley value of feature i."""
    weights = []
    for i in range(k):
        factors = []
        for subset in range(2**k):
            size = bin(subset).count("1")
            if subset >> i & 1:
                factors.append(factorial(size - 1) * factorial(k - size) / factorial(k))
            else:
                factors.append(-factorial(size) * factorial(k - size - 1) / factorial(k))
        weights.append(factors)
    return weights


def _check_width(k: int, most: int) -> None:
    if k > most:
        raise ValueError(f"exact attribution of {k} features needs 2^{k} scores per row; at most {most}")


def explode_contributions(explained: DataFrame) -> DataFrame:
    """Long form: ids, base_value, feature, value, shap."""
    rest = [col_named(c) for c in explained.columns if c != "contributions"]
    return explained.select(*rest, F.inline("contributions"))


def raw_attributions(explained: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide form: one column of attributions per feature."""
    return explained.select(
        *[col_named(c) for c in ids],
        *[F.col("contributions")[i]["shap"].alias(f) for i, f in enumerate(features)],
    )


def _ranked(explained: DataFrame) -> DataFrame:
    """Contributions by descending size, ties by name, with their rank from 1."""
    keyed = F.transform(
        "contributions",
        lambda c: F.struct((-F.abs(c["shap"])).alias("order"), c["feature"].alias("feature"), c.alias("cell")),
    )
    rest = [col_named(c) for c in explained.columns if c != "contributions"]
    return explained.select(*rest, F.array_sort(keyed).alias("_sorted"))


def contribution_table(explained: DataFrame, wording: tuple[str, str] = DIRECTION_RISK) -> DataFrame:
    """Per row and feature: value, shap, its size, its direction in words and its rank."""
    ranked = _ranked(explained)
    rest = [col_named(c) for c in ranked.columns if c != "_sorted"]
    flat = ranked.select(*rest, F.posexplode("_sorted").alias("_at", "_item"))
    shap = F.col("_item")["cell"]["shap"]
    return flat.select(
        *rest,
        F.col("_item")["feature"].alias("feature"),
        F.col("_item")["cell"]["value"].alias("value"),
        shap.alias("shap"),
        F.abs(shap).alias("abs_shap"),
        direction(shap, wording).alias("direction"),
        (F.col("_at") + 1).cast("long").alias("rank"),
    )


def shap_sum(contributions: str = "contributions") -> Column:
    return F.aggregate(contributions, F.lit(0.0), lambda total, c: total + c["shap"])


def top_rows(explained: DataFrame, ids: list[str], top_n: int = 10) -> DataFrame:
    """The rows with the highest signed sum of attributions; ties by id."""
    summed = explained.withColumn("shap_total", shap_sum())
    return summed.orderBy(F.col("shap_total").desc(), *[col_named(c) for c in ids]).limit(top_n)


def waterfall_table(explained: DataFrame, ids: list[str], top_n: int = 10) -> DataFrame:
    """For the top rows: contributions by rank, and the running value from base to score."""
    ranked = _ranked(top_rows(explained, ids, top_n).drop("shap_total"))
    sums = F.aggregate(
        "_sorted",
        F.array(F.col("base_value")),
        lambda done, item: F.array_append(done, F.element_at(done, -1) + item["cell"]["shap"]),
    )
    rest = [col_named(c) for c in [*ids, "base_value"]]
    flat = ranked.withColumn("_sums", sums).select(*rest, "_sums", F.posexplode("_sorted").alias("_at", "_item"))
    return flat.select(
        *rest,
        (F.col("_at") + 1).cast("long").alias("rank"),
        F.col("_item")["feature"].alias("feature"),
        F.col("_item")["cell"]["value"].alias("value"),
        F.col("_item")["cell"]["shap"].alias("shap"),
        F.get("_sums", F.col("_at")).alias("running_before"),
        F.get("_sums", F.col("_at") + 1).alias("running_after"),
    )


def global_importance(explained: DataFrame, top_n: int | None = None) -> DataFrame:
    """Mean size of each feature's attributions, largest first."""
    means = (
        explode_contributions(explained)
        .groupBy("feature")
        .agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
        .orderBy(F.col("mean_abs_shap").desc(), "feature")
    )
    return means if top_n is None else means.limit(top_n)


def beeswarm_table(explained: DataFrame) -> DataFrame:
    """Every attribution with its feature's place in the global ranking."""
    # One row per feature: the window is as short as the feature list.
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("mean_abs_shap").desc(), "feature"))
    # Stored: the join measures the ranking before it uses it.
    places = materialize(global_importance(explained).select("feature", rank.cast("long").alias("feature_rank")))
    return sized_join(explode_contributions(explained), places, ["feature"])
