"""Joins of a large table with a smaller one: broadcast if it fits, salted where a key is hot."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

from stayline.functions.predicates import col_named

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
HOT_SHARE = 0.005
SAMPLE = 0.01


def table_bytes(df: DataFrame) -> int | None:
    """Size of the rows by one aggregate over the frame; None if a column cannot be sized."""
    if not all(isinstance(f.dataType, AtomicType) for f in df.schema.fields):
        return None
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.octet_length(col_named(t))).alias(f"t{i}") for i, t in enumerate(texts)],
    ).first()
    text_bytes = sum(row[f"t{i}"] or 0 for i in range(len(texts)))
    return row["n"] * (16 + 8 * len(df.columns)) + text_bytes


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    if max_bytes <= 0:
        return False
    size = table_bytes(df)
    return size is not None and size <= max_bytes


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE, sample: float = SAMPLE) -> list[tuple]:
    """Keys that hold at least `share` of the rows: at most 1/share of them.

    Only a sample of the key columns is counted. The list steers how rows are spread over
    tasks, never which rows are in the result, so the sample does not make it inexact.
    """
    keys = df.select(*[col_named(c) for c in on]).dropna()
    if sample < 1.0:
        keys = keys.sample(fraction=sample, seed=7)
    # The total is observed on the counts while the largest are picked: one pass over the facts.
    rows = Observation()
    counts = keys.groupBy(*[col_named(c) for c in on]).count().observe(rows, F.sum("count").alias("total"))
    top = counts.orderBy(F.col("count").desc()).limit(int(1 / share)).collect()
    if not top:
        return []
    return [tuple(row[c] for c in on) for row in top if row["count"] >= share * rows.get["total"]]


def _is_one_of(on: list[str], keys: list[tuple]) -> Column:
    if len(on) == 1:
        return col_named(on[0]).isin([k[0] for k in keys])
    return reduce(or_, [reduce(and_, [col_named(c) == v for c, v in zip(on, key)]) for key in keys])


def sized_join(
    facts: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    hot_share: float = HOT_SHARE,
    sample: float = SAMPLE,
) -> DataFrame:
    """Equi-join (inner, left or left_semi) which survives a key with a large share of the facts.

    The smaller side is measured, so it should be stored or cheap to compute. Up to `max_bytes` it is
    broadcast and the facts are not shuffled. Beyond that both sides are shuffled on the key, and the rows of hot keys also
    on a salt: their facts spread over `salts` tasks and the few matching rows of the other
    side are repeated for each salt. The salt is made of the row's values and its
    partition, which a repeated task attempt reproduces, and which also splits exact copies.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type: {how}")
    if fits_broadcast(small, max_bytes):
        return facts.join(F.broadcast(small), on, how)
    hot = hot_keys(facts, on, hot_share, sample)
    if not hot:
        return facts.join(small, on, how)
    is_hot = F.coalesce(_is_one_of(on, hot), F.lit(False))
    spread = F.pmod(
        F.xxhash64(*[col_named(c) for c in facts.columns]) + F.spark_partition_id(), F.lit(salts)
    ).cast("int")
    salted_facts = facts.withColumn("_salt", F.when(is_hot, spread).otherwise(0))
    salted_small = small.withColumn(
        "_salt",
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted_facts.join(salted_small, [*on, "_salt"], how).drop("_salt")
