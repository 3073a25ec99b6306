"""Attributions of any score over many features, against a background of many rows, by walks through the features.

A walk takes the features of a row one by one in a drawn order, the others staying at the background, and credits each
feature with what its step adds to the mean score over the background. Walks come in pairs, an order and its reverse, which
cancels much of the noise. Every walk adds up to the score minus the base, so their mean does too; how far the pairs of a
row differ gives the standard error of each attribution; it is too small where a step matters only on walks that few pairs take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from stayline.functions.predicates import col_named
from stayline.session import ship_package

PAIRS = 32
SEED = 17
#: Different background rows; more must be asked for, as every one is scored at every step.
MAX_BACKGROUND = 1000
#: Cells of the table that is scored in one call.
CELLS = 1 << 20


def weighted_background(df: DataFrame, features: list[str], most: int = MAX_BACKGROUND) -> tuple[np.ndarray, np.ndarray]:
    """The different complete rows of the features, sorted, and the share of each; more than `most` raise an error.

    Rows with a null or NaN feature are no background. Counted on the executors; at most `most` + 1 rows come back.
    """
    doubled = df.select(*[col_named(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    names = doubled.columns
    for name in names:
        doubled = doubled.filter(F.col(name).isNotNull() & ~F.isnan(name))
    rows = doubled.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the background has more than {most} different rows; bin it or raise `most`")
    if not rows:
        raise ValueError("the background has no complete row")
    table = np.array(sorted(tuple(r) for r in rows), dtype=float)
    return table[:, :-1], table[:, -1] / table[:, -1].sum()


def drawn_orders(k: int, pairs: int = PAIRS, seed: int = SEED) -> np.ndarray:
    """(pairs, 2, k): orders of k features, each beside its reverse; all of them once if there are no more than asked for."""
    if k < 2:
        half = np.zeros((1, k), dtype=int)
    elif k <= 9 and factorial(k) <= 2 * pairs:
        half = np.array([p for p in permutations(range(k)) if p[0] < p[-1]])
    else:
        draw = np.random.default_rng(seed)
        half = np.array([draw.permutation(k) for _ in range(pairs)])
    return np.stack([half, half[:, ::-1]], axis=1)


def _steps(orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different sets of features met on the walks, and per (pair, way, feature) the set before and after its step."""
    pairs, _, k = orders.shape
    numbers: dict[bytes, int] = {}
    before, after = np.zeros((pairs, 2, k), dtype=int), np.zeros((pairs, 2, k), dtype=int)
    for p in range(pairs):
        for way in range(2):
            on = np.zeros(k, dtype=bool)
            at = numbers.setdefault(on.tobytes(), len(numbers))
            for feature in orders[p, way]:
                before[p, way, feature] = at
                on[feature] = True
                at = numbers.setdefault(on.tobytes(), len(numbers))
                after[p, way, feature] = at
    return np.array([np.frombuffer(b, dtype=bool) for b in numbers]).reshape(len(numbers), k), before, after


def walk_shapley(
    df: DataFrame,
    features: list[str],
    predict: Callable[[np.ndarray], np.ndarray],
    ids: list[str],
    background: tuple[np.ndarray, np.ndarray] | None = None,
    pairs: int = PAIRS,
    seed: int = SEED,
) -> DataFrame:
    """An explained frame whose contributions also hold `error`, the standard error of each attribution.

    `predict` maps a (rows, features) array to scores; `background` is that of `weighted_background`, one row of zeros by
    default. base_value is the mean score over the background, and base_value plus the attributions is the row's score, up to
    rounding. Where the walks are all orders there are, the attributions are the exact Shapley values and the errors are 0.
    The orders depend on the seed alone, so neither partitioning nor a repeated task changes a row's result. A row is scored at
    most 2 * pairs * (k - 1) + 2 times per background row, a bounded number of cells at a time. A null feature is NaN to `predict`.
    """
    k = len(features)
    rows_of, shares = background if background is not None else (np.zeros((1, k)), np.ones(1))
    orders = drawn_orders(k, pairs, seed)
    whole = k < 2 or len(orders) * 2 == (factorial(k) if k <= 9 else 0)
    on, before, after = _steps(orders)
    ship_package(df.sparkSession)
    inner = [f"_f{i}" for i in range(k)]
    rows = df.select(
        *[col_named(c).alias(f"_i{i}") for i, c in enumerate(ids)],
        *[col_named(f).cast("double").alias(n) for f, n in zip(features, inner)],
    )
    extra = [StructField("_base", DoubleType()), StructField("_shap", ArrayType(DoubleType())), StructField("_error", ArrayType(DoubleType()))]
    schema = StructType([*rows.schema.fields, *extra])

    def mean_scores(values: np.ndarray) -> np.ndarray:
        """(rows, sets): the mean over the background with the features of a set taken from the row."""
        out = np.empty((len(values), len(on)))
        sets = max(1, CELLS // (len(rows_of) * max(k, 1)))
        for low in range(0, len(on), sets):
            some = on[low : low + sets]
            step = max(1, CELLS // (len(some) * len(rows_of) * max(k, 1)))
            for at in range(0, len(values), step):
                part = values[at : at + step]
                cells = np.where(some[None, :, None, :], part[:, None, None, :], rows_of[None, None])
                scores = np.asarray(predict(cells.reshape(-1, k)), dtype=float).reshape(len(part), len(some), len(rows_of))
                out[at : at + step, low : low + sets] = scores @ shares
        return out

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[inner].to_numpy(dtype=float)
            # A pair's gains take pairs * k numbers a row.
            step = max(1, CELLS // (2 * len(orders) * max(k, 1)))
            means, shaps, errors = [], [], []
            for low in range(0, len(values), step):
                scores = mean_scores(values[low : low + step])
                gains = (scores[:, after] - scores[:, before]).mean(axis=2)
                means += scores[:, 0].tolist()
                shaps += gains.mean(axis=1).tolist()
                spread = gains.std(axis=1, ddof=1) / np.sqrt(len(orders)) if len(orders) > 1 and not whole else np.zeros(gains[:, 0].shape)
                # One drawn pair says nothing of its error.
                errors += (spread if whole or len(orders) > 1 else np.full_like(spread, np.nan)).tolist()
            yield batch.assign(_base=means, _shap=shaps, _error=errors)[schema.fieldNames()]

    scored = rows.mapInPandas(attribute, schema)
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col(n).alias("value"), F.col("_shap")[i].alias("shap"), F.col("_error")[i].alias("error"))
        for i, (f, n) in enumerate(zip(features, inner))
    ]
    contributions = F.array(*cells) if cells else F.array().cast("array<struct<feature:string,value:double,shap:double,error:double>>")
    return scored.select(*[F.col(f"_i{i}").alias(c) for i, c in enumerate(ids)], F.col("_base").alias("base_value"), contributions.alias("contributions"))
