"""Logistic and boosted-tree models, scores and their quality measures."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named, number_or_null
from stayline.operators.prep import scale_columns
from stayline.sources.tables import materialize, save_dataset

# Names of the two columns a scored frame gains.
PREDICTED_CLASS = "predicted_mortality_30d"
PREDICTED_PROBABILITY = "predicted_probability"

AUC_BIN_ROWS = 100_000
AUC_BINS = 10_000


@dataclass
class LogisticModel:
    """Coefficients on scaled features, with the scaler and medians they were fitted with."""

    features: list[str]
    weights: list[float]
    intercept: float
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)

    def margin(self, values: dict[str, Column] | None = None) -> Column:
        """Log-odds of a row of scaled features; `values` replaces the columns by other ones."""
        total = F.lit(float(self.intercept))
        for name, weight in zip(self.features, self.weights):
            total = total + F.lit(float(weight)) * (col_named(name) if values is None else values[name])
        return total

    def probability(self, values: dict[str, Column] | None = None) -> Column:
        return logistic(self.margin(values))

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of a (rows, features) array of scaled features, inside a task."""
        return 1.0 / (1.0 + np.exp(-(rows @ np.array(self.weights) + self.intercept)))

    def scale(self, df: DataFrame) -> DataFrame:
        return scale_columns(df, self.scaler)

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row per feature in order, and a last row for the intercept."""
        rows = [
            (i, name, float(weight), *self.scaler.get(name, (None, None)), self.medians.get(name))
            for i, (name, weight) in enumerate(zip(self.features, self.weights))
        ]
        rows.append((len(rows), None, float(self.intercept), None, None, None))
        schema = "position INT, feature STRING, weight DOUBLE, mean DOUBLE, deviation DOUBLE, median DOUBLE"
        save_dataset(spark.createDataFrame(rows, schema).coalesce(1), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogisticModel:
        """Raises if there is no model at `path`."""
        rows = spark.read.parquet(path).orderBy("position").collect()
        parts = [r for r in rows if r.feature is not None]
        return cls(
            [r.feature for r in parts],
            [r.weight for r in parts],
            next(r.weight for r in rows if r.feature is None),
            {r.feature: (r["mean"], r.deviation) for r in parts if r["mean"] is not None},
            {r.feature: r["median"] for r in parts if r["median"] is not None},
        )


def logistic(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def assemble(df: DataFrame, features: list[str], output: str = "_features") -> DataFrame:
    """Adds a vector of the features. The assembler reads plain names, so odd ones get an alias."""
    aliased = df.withColumns({f"_f{i}": col_named(c).cast("double") for i, c in enumerate(features)})
    inputs = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error").transform(aliased).drop(*inputs)


def fit_logistic(
    train: DataFrame, features: list[str], target: str, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6
) -> LogisticModel:
    """L2-penalised logistic regression on rows that are scaled already.

    Spark divides the objective by the number of rows, hence the penalty 1/(n*c).
    """
    data = assemble(train, features).select("_features", col_named(target).cast("double").alias("_label"))
    n = data.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    fitted = LogisticRegression(
        featuresCol="_features",
        labelCol="_label",
        family="binomial",
        regParam=1.0 / (n * c),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(data)
    return LogisticModel(list(features), [float(w) for w in fitted.coefficients], float(fitted.intercept))


def score_logistic(df: DataFrame, model: LogisticModel) -> DataFrame:
    """Appends class and positive probability to rows of scaled features; a gap gives null."""
    return append_score(df, model.margin())


def append_score(df: DataFrame, margin: Column) -> DataFrame:
    """The margin is a column of its own, so that its long sum appears once in the plan."""
    return df.withColumn("_margin", margin).select(
        *[col_named(c) for c in df.columns],
        F.when(F.col("_margin").isNotNull(), (F.col("_margin") > 0).cast("long")).alias(PREDICTED_CLASS),
        logistic(F.col("_margin")).alias(PREDICTED_PROBABILITY),
    )


def fit_boosted_trees(
    train: DataFrame,
    features: list[str],
    target: str,
    trees: int = 100,
    depth: int = 4,
    rate: float = 0.1,
    seed: int = 42,
) -> GBTClassificationModel:
    data = assemble(train, features).select("_features", col_named(target).cast("double").alias("_label"))
    return GBTClassifier(
        featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed
    ).fit(data)


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    The rows are counted once by (label, prediction); all the rest is arithmetic on these counts.
    """
    counts = (
        df.select(col_named(label).cast("string").alias("y"), col_named(prediction).cast("string").alias("p"))
        .dropna()
        .groupBy("y", "p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("y").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("p").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        )
    )
    zero = F.lit(0.0)
    classes = (
        sides.groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .withColumn("precision", F.coalesce(F.try_divide("hits", "predicted"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("hits", "support"), zero))
        .withColumn("f1_score", F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), zero))
    )
    measures = ["precision", "recall", "f1_score"]
    total = F.sum("support")
    accuracy = F.sum("hits") / total
    means = classes.agg(
        total.alias("n"),
        accuracy.alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in measures],
    ).filter(F.col("n") > 0)
    lines = [
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in measures], F.col("n").alias("support"))
    ]
    for kind in ("macro", "weighted"):
        lines.append(
            F.struct(
                F.lit(f"{kind} avg").alias("class"),
                *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                F.col("n").alias("support"),
            )
        )
    return classes.select("class", *measures, "support").unionByName(means.select(F.inline(F.array(*lines))))


def roc_auc(df: DataFrame, label: str, score: str, bin_rows: int = AUC_BIN_ROWS) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs ordered rightly, ties half.

    Rows are first counted per distinct score. The scores are cut into bins of about `bin_rows`
    distinct scores, up to AUC_BINS of them; the negatives below a bin come from a running sum over the bins
    (one small row each), those inside it from a running sum partitioned by bin. The
    arithmetic is on whole numbers, so the result does not depend on the order of the rows.
    The counts are written once, as three steps read them.
    """
    y = col_named(label).cast("double")
    counted = materialize(
        df.select(number_or_null(col_named(score).cast("double")).alias("score"), y.alias("y"))
        .dropna()
        .groupBy("score")
        .agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg"))
    )
    bins = max(2, min(AUC_BINS, counted.count() // bin_rows))
    shares = [i / bins for i in range(1, bins)]
    edges = counted.agg(F.percentile_approx("score", shares, 10 * bins)).first()[0]
    splits = [float("-inf"), *sorted(set(edges or [0.0])), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="score", outputCol="bin", handleInvalid="keep").transform(counted)
    # At most `bins` rows from here: a window over all of them is one short running sum.
    offsets = binned.groupBy("bin").agg(F.sum("neg").alias("bin_neg")).select(
        "bin",
        (F.sum("bin_neg").over(W.partitionBy(F.lit(0)).orderBy("bin")) - F.col("bin_neg")).alias("below_bin"),
    )
    inside = W.partitionBy("bin").orderBy("score")
    ranked = binned.withColumn("below_in_bin", F.sum("neg").over(inside) - F.col("neg"))
    exact = "decimal(38,0)"
    below = F.col("below_bin") + F.col("below_in_bin")
    pairs = F.col("pos").cast(exact) * (2 * below + F.col("neg")).cast("decimal(20,0)")
    summed = ranked.join(offsets, "bin").agg(
        F.sum(pairs.cast(exact)).alias("twice_won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    possible = F.col("pos").cast("double") * F.col("neg").cast("double")
    return summed.select(
        F.when(possible > 0, F.col("twice_won").cast("double") / (2.0 * possible)).alias("auc"),
        "pos",
        "neg",
    )
