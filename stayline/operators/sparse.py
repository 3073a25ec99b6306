"""Features of very many labels as one sorted array per row, made wide for the chosen ones only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named, has_number
from stayline.operators.features import MAX_LABELS, STATS
from stayline.operators.joins import sized_join
from stayline.sources.tables import materialize

FEATURES = "_features"


@dataclass
class FeatureNumbers:
    """`labels`: (set, label, number), numbers from 0 in the order of label and set; `names`: (feature, set, label,
    stat, name), with feature = number * statistics + place of the statistic. Both are stored tables."""

    sets: list[str]
    stats: tuple[str, ...]
    labels: DataFrame
    names: DataFrame


def number_labels(sets: Mapping[str, DataFrame], label: str, stats: tuple[str, ...] = STATS) -> FeatureNumbers:
    """Numbers and names of the features of every label that occurs in the sets; null labels are left out.

    The labels are sorted by range, numbered inside each range, and moved on by the sizes of the ranges before it: no
    task sees them all, and the numbers do not depend on the partitioning. A name that two sets share gets the suffix
    `_x` in the first and `_y` in the second, as in `merge_features`; labels of one set that give the same name raise,
    and so does a name of more than two sets.
    """
    found = reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("set"), col_named(label).alias("label")) for s, df in sets.items()])
    ranged = found.dropna().distinct().repartitionByRange("label", "set").sortWithinPartitions("label", "set")
    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    # One row a range: a window over all of them is one short running sum.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")
    inside = F.row_number().over(W.partitionBy("_part").orderBy("label", "set"))
    numbered = placed.withColumn("_at", inside).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    labels = materialize(numbered.select("set", "label", (F.col("_before") + F.col("_at") - 1).cast("long").alias("number")))

    each = labels.select("*", F.posexplode(F.array(*[F.lit(s) for s in stats])).alias("_place", "stat"))
    plain = F.replace(F.lower(F.concat("stat", F.lit("_"), "label")), F.lit(" "), F.lit("_"))
    order = F.array_position(F.array(*[F.lit(s) for s in sets]), F.col("set"))
    named = each.select(
        (F.col("number") * len(stats) + F.col("_place")).alias("feature"), "set", "label", "stat", plain.alias("name"), order.alias("_set")
    )
    # A name's rows are as many as its labels that differ in case and blanks only; their sets are counted without gathering them.
    same = named.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("_set").alias("_first"), F.max("_set").alias("_last"))
    shared = materialize(same.filter(F.col("_n") > 1))
    twice = shared.filter((F.col("_n") > 2) | (F.col("_first") == F.col("_last"))).limit(5).collect()
    if twice:
        raise ValueError(f"labels that give the same feature name: {sorted(row.name for row in twice)}")
    suffix = F.when(F.col("_n").isNull(), "").when(F.col("_set") == F.col("_first"), "_x").otherwise("_y")
    names = sized_join(named, shared, ["name"], "left").select("feature", "set", "label", "stat", F.concat("name", suffix).alias("name"))
    return FeatureNumbers(list(sets), tuple(stats), labels, materialize(names))


def sparse_features(sets: Mapping[str, DataFrame], entity: str, label: str, numbers: FeatureNumbers) -> DataFrame:
    """One row per entity: `_features`, an array of (feature, value) in the order of the feature; gaps are not in it.

    Each set is the long form of `time_series_long`, one row per (entity, label). Only the filled cells are
    shuffled, once; an entity's array is at most as long as its labels allow.
    """
    cells = []
    for name, long in sets.items():
        values = [F.struct(F.lit(i).alias("place"), col_named(s).cast("double").alias("value")) for i, s in enumerate(numbers.stats)]
        filled = F.filter(F.array(*values), lambda cell: has_number(cell["value"]))
        cells.append(long.select(col_named(entity), F.lit(name).alias("set"), col_named(label).alias("label"), filled.alias("_cells")))
    known = sized_join(reduce(DataFrame.unionByName, cells), numbers.labels, ["set", "label"])
    start = F.col("number") * len(numbers.stats)
    moved = F.transform("_cells", lambda cell: F.struct((start + cell["place"]).alias("feature"), cell["value"].alias("value")))
    lists = known.select(col_named(entity), moved.alias("_cells")).groupBy(col_named(entity))
    return lists.agg(F.array_sort(F.flatten(F.collect_list("_cells"))).alias(FEATURES))


def merge_sparse(base: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """Every base row with the array of its entity; an entity without features has an empty one."""
    merged = sized_join(base, features, on, "left")
    return merged.withColumn(FEATURES, F.coalesce(FEATURES, F.array().cast(features.schema[FEATURES].dataType)))


def feature_coverage(rows: DataFrame) -> DataFrame:
    """Per feature that occurs: in how many rows, and their share of all rows. Partial counts, no gathering."""
    total = rows.count()
    counts = rows.select(F.explode(F.col(FEATURES)["feature"]).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("coverage", F.col("n_rows") / F.lit(total))


def covered_names(
    rows: DataFrame,
    numbers: FeatureNumbers,
    min_coverage: float = 0.8,
    protect: list[str] | None = None,
    ignore: list[str] | None = None,
    max_features: int = MAX_LABELS,
) -> dict[int, str]:
    """Number and name of the features filled in more than `min_coverage` of the rows, in the order of set, statistic and label.

    `protect` names always stay, `ignore` names always go. The shares of all features add up to the mean length of the arrays, so at
    most that length / `min_coverage` features can be kept, however many there are; more than `max_features` raise.
    """
    wanted = F.col("coverage") > min_coverage
    known = numbers.names
    if protect:
        # A protected feature stays even if no row has it.
        wanted = F.coalesce(wanted, F.lit(False)) | F.col("name").isin(protect)
    if ignore:
        known = known.filter(~F.col("name").isin(ignore))
    shares = sized_join(known, materialize(feature_coverage(rows)), ["feature"], "left" if protect else "inner")
    kept = shares.filter(wanted).select("feature", "set", "stat", "label", "name").limit(max_features + 1).collect()
    if len(kept) > max_features:
        raise ValueError(f"more than {max_features} features are kept: ask for a higher coverage")
    ordered = sorted(kept, key=lambda r: (numbers.sets.index(r["set"]), numbers.stats.index(r.stat), r.label))
    return {r.feature: r.name for r in ordered}


def keep_features(rows: DataFrame, kept: Mapping[int, str], complete: bool = False) -> DataFrame:
    """The arrays with the kept features only; with `complete`, only the rows that have all of them. No shuffle."""
    held = F.filter(FEATURES, lambda cell: cell["feature"].isin(list(kept))) if kept else F.slice(FEATURES, 1, 0)
    narrow = rows.withColumn(FEATURES, held)
    return narrow.filter(F.size(FEATURES) == len(kept)) if complete else narrow


def widen(rows: DataFrame, kept: Mapping[int, str], complete: bool = False) -> DataFrame:
    """A column for each of the kept features, in their order, instead of the array.

    Rows known to be `complete` after `keep_features` are read by place; others by looking a feature up in the row.
    A base column of the same name raises.
    """
    base = [c for c in rows.columns if c != FEATURES]
    both = sorted(set(base) & set(kept.values()))
    if both:
        raise ValueError(f"features named like columns: {both}")

    def cell(feature: int) -> Column:
        if complete:
            return F.get(FEATURES, F.lit(places[feature]))["value"]
        return F.get(F.filter(FEATURES, lambda c: c["feature"] == feature), F.lit(0))["value"]

    places = {feature: at for at, feature in enumerate(sorted(kept))}
    return rows.select(*[col_named(c) for c in base], *[cell(f).alias(name) for f, name in kept.items()])
