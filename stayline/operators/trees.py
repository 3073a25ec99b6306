"""Attribution of boosted trees against background rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stayline.functions.predicates import col_named, number_or_null
from stayline.operators.explain import explained_frame
from stayline.operators.prep import sample_rows
from stayline.session import ship_package, work_path
from stayline.sources.tables import save_model


@dataclass
class Leaf:
    """A leaf: its share of the margin, and the interval (low, high] of each feature on its path."""

    value: float
    bounds: dict[int, tuple[float, float]]


def leaf_table(model: GBTClassificationModel, spark) -> list[Leaf]:
    """The leaves of all trees, read from the saved model; as many as the model has, whatever the data."""
    path = work_path(spark, "trees")
    save_model(model, path)
    stored = spark.read.parquet(f"{path}/data")
    nodes = stored.select("treeID", "nodeData.*").select(
        "treeID",
        "id",
        "prediction",
        "leftChild",
        "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    trees: dict[int, dict[int, object]] = {}
    for node in nodes.collect():
        trees.setdefault(node.treeID, {})[node.id] = node
    leaves = []
    for number, tree in trees.items():
        # The margin in log-odds is twice the weighted sum of the trees.
        scale = 2.0 * model.treeWeights[number]
        waiting = [(0, {})]
        while waiting:
            place, bounds = waiting.pop()
            node = tree[place]
            if node.leftChild < 0:
                leaves.append(Leaf(scale * node.prediction, bounds))
                continue
            low, high = bounds.get(node.feature, (-np.inf, np.inf))
            waiting.append((node.leftChild, bounds | {node.feature: (low, min(high, node.threshold))}))
            waiting.append((node.rightChild, bounds | {node.feature: (max(low, node.threshold), high)}))
    return leaves


@cache
def _shares(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row patterns, background patterns, shares): what each path feature gets of a leaf's value.

    Bit i of a pattern says that the row satisfies path feature i. Only the 3^size pairs of
    patterns that satisfy every feature between them give a leaf anything to share.
    """
    both = [(a, c) for a in range(2**size) for c in range(2**size) if a | c == 2**size - 1]
    shares = np.zeros((len(both), size))
    for at, (a, c) in enumerate(both):
        p, q = (a & ~c).bit_count(), (c & ~a).bit_count()
        for i in range(size):
            if (a & ~c) >> i & 1:
                shares[at, i] = factorial(p - 1) * factorial(q) / factorial(p + q)
            elif (c & ~a) >> i & 1:
                shares[at, i] = -factorial(p) * factorial(q - 1) / factorial(p + q)
    return np.array([a for a, _ in both]), np.array([c for _, c in both]), shares


def _codes(rows: np.ndarray, features: list[int], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    held = (rows[:, features] > low) & (rows[:, features] <= high)
    return held @ (1 << np.arange(len(features)))


def _paths(leaves: list[Leaf]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Path features of each leaf and their bounds."""
    paths = []
    for leaf in leaves:
        features = sorted(leaf.bounds)
        paths.append((features, *(np.array([leaf.bounds[f][side] for f in features]) for side in (0, 1))))
    return paths


def pattern_counts(background: DataFrame, features: list[str], leaves: list[Leaf]) -> dict[int, dict[int, int]]:
    """How many background rows show each pattern of each leaf: {leaf: {pattern: rows}}.

    Every task counts its rows; at most leaves * 2^depth sums come to the driver. Rows with a gap in
    a feature have no score and are left out.
    """
    paths = _paths(leaves)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [np.zeros(2 ** len(path[0]), np.int64) for path in paths]
        for batch in batches:
            rows = batch.to_numpy(dtype=float)
            rows = rows[~np.isnan(rows).any(axis=1)]
            for total, path in zip(found, paths):
                total += np.bincount(_codes(rows, *path), minlength=len(total)) if path[0] else len(rows)
        cells = [(leaf, code, n) for leaf, total in enumerate(found) for code, n in enumerate(total) if n]
        yield pd.DataFrame(cells, columns=["leaf", "pattern", "n"])

    rows = _plain(background, [], features)
    sums = rows.mapInPandas(count, "leaf int, pattern int, n long").groupBy("leaf", "pattern").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[int, int]] = {i: {} for i in range(len(leaves))}
    for row in sums.collect():
        counts[row["leaf"]][row["pattern"]] = row["n"]
    return counts


def _plain(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Ids and features under plain names, as batches are looked up by name: `_i0`..., `_f0`..."""
    return df.select(
        *[col_named(c).alias(f"_i{i}") for i, c in enumerate(ids)],
        *[col_named(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)],
    )


@dataclass
class TreeAttribution:
    """For every leaf: path features, their bounds, and attribution by the row's bit pattern.

    The background is summed into the patterns once, so a row costs one lookup per leaf.
    """

    base: float
    leaves: list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, leaves: list[Leaf], counts: dict[int, dict[int, int]]) -> TreeAttribution:
        base, kept = 0.0, []
        for number, (leaf, (features, low, high)) in enumerate(zip(leaves, _paths(leaves))):
            size, total = len(features), sum(counts[number].values())
            if not total:
                raise ValueError("the background has no complete rows")
            share = np.zeros(2**size)
            for pattern, n in counts[number].items():
                share[pattern] = n / total
            base += leaf.value * share[-1]
            if features:
                ours, theirs, parts = _shares(size)
                table = np.zeros((2**size, size))
                np.add.at(table, ours, leaf.value * share[theirs, None] * parts)
                kept.append((features, low, high, table))
        return cls(float(base), kept)

    def attribute(self, rows: np.ndarray) -> np.ndarray:
        """Attributions of every row; a row with a gap has no score, and gets NaN."""
        out = np.zeros(rows.shape)
        for features, low, high, table in self.leaves:
            out[:, features] += table[_codes(rows, features, low, high)]
        out[np.isnan(rows).any(axis=1)] = np.nan
        return out


def tree_shap(
    df: DataFrame,
    model: GBTClassificationModel | list[Leaf],
    features: list[str],
    ids: list[str],
    background: DataFrame,
    background_key: list[str] | None = None,
    background_rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Explained frame of the log-odds of boosted trees (interventional Shapley values, exact).

    The background is all rows of `background`, or, if asked, a reproducible sample of `background_rows`.
    The rows stream through Arrow batches; each task holds the leaf tables only. A row with a gap
    in a feature gets null attributions. Instead of a model its leaves may be given.
    """
    spark = df.sparkSession
    ship_package(spark)
    if background_rows is not None:
        background = sample_rows(background, background_key or ids, background_rows, seed)
    leaves = model if isinstance(model, list) else leaf_table(model, spark)
    attribution = TreeAttribution.build(leaves, pattern_counts(background, features, leaves))
    shared = spark.sparkContext.broadcast(attribution)
    names = [f"_shap{i}" for i in range(len(features))]
    cells = [f"_f{i}" for i in range(len(features))]
    rows = _plain(df, ids, features)
    schema = StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = shared.value.attribute(batch[cells].to_numpy(dtype=float))
            yield pd.concat([batch, pd.DataFrame(values, columns=names, index=batch.index)], axis=1)

    scored = rows.mapInPandas(attribute, schema)
    named = scored.select(
        *[F.col(f"_i{i}").alias(c) for i, c in enumerate(ids)],
        *[F.col(c).alias(f) for c, f in zip(cells, features)],
        *[number_or_null(F.col(n)).alias(n) for n in names],
    )
    return explained_frame(named, ids, F.lit(attribution.base), [(f, F.col(n)) for f, n in zip(features, names)])
