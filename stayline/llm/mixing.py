"""Mixing sources to target weights by fitting a word budget as a subset sum.

The sources share a budget by weight, none taking more than three times what it has. Within a source every document is
taken the same whole number of times, and what is left of the target is made up by single documents: the count of
documents of each length is scaled to it, and a bounded-knapsack program over the counts left closes the rest. Which
documents of a length are taken is decided by a seeded hash. Only counts per source and length are fitted, so the work of
a source is bounded by its longest text; documents are ranked inside chunks, so no group of equal lengths meets in one task.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.sources.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 8
#: Words that the knapsack program closes; what lies above is taken greedily, longest first.
CAPACITY = 1 << 16
#: Copies of every length that are left to the program where a budget lies above CAPACITY.
SPARE = 8
CHUNK_ROWS = 1000
MOST_CHUNKS = 1 << 16


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the sum of sizes by the repeating weights; no share above `most` times its size, the excess shared again."""
    budget, got = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_ and budget > 0:
        total = sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if budget * weights[i % len(weights)] > most * sizes[i] * total}
        if not over:
            for i in open_:
                got[i] = budget * weights[i % len(weights)] / total
            break
        for i in over:
            got[i] = Fraction(most * sizes[i])
            budget -= got[i]
        open_ -= over
    return [float(g) for g in got]


def closest_subset(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes near the budget, the lower sum in a draw.

    A budget up to CAPACITY goes through the program whole: no other choice comes nearer. Beyond it every length first gives its
    share of all but CAPACITY / 2 words, except SPARE copies, and what is left is taken longest first down to CAPACITY / 2 words
    and closed by the program over all copies left. The gap is then at most half of the longest length.
    """
    counts = {length: n for length, n in counts.items() if length > 0 and n > 0}
    whole = sum(length * n for length, n in counts.items())
    if budget >= whole:
        return counts
    taken, left = dict.fromkeys(counts, 0), budget
    if budget > CAPACITY:
        scaled = budget - CAPACITY // 2
        taken = {length: min(n * scaled // whole, max(0, n - SPARE)) for length, n in counts.items()}
        left -= sum(length * n for length, n in taken.items())
        for length in sorted(counts, reverse=True):
            more = min(counts[length] - taken[length], max(0, left - CAPACITY // 2) // length)
            taken[length] += more
            left -= more * length
    if left > CAPACITY:
        # Every text left is longer than what the program need not close: one more, and the program if that stays below.
        shortest = min(length for length in counts if taken[length] < counts[length])
        if shortest < 2 * left:
            taken[shortest] += 1
        if shortest >= left:
            return taken
        left -= shortest
    # Bits of `reach` are the sums that can be had, up to twice what is left; each step offers 1, 2, 4, ... further documents
    # of one length.
    reach, steps, mask = 1, [], (1 << (2 * left + 1)) - 1
    for length in sorted(counts):
        spare = min(counts[length] - taken[length], 2 * left // length)
        pack = 1
        while spare > 0 and not reach >> left & 1:
            pack = min(pack, spare)
            grown = (reach | reach << (pack * length)) & mask
            if grown != reach:
                steps.append((reach, length, pack))
                reach = grown
            spare -= pack
            pack *= 2
    under = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    over = reach >> (left + 1)
    # The lowest sum above, if it is nearer than the highest up to the budget.
    above = left + (over & -over).bit_length() if over else 2 * left + 1
    best = above if above - left < left - under else under
    for before, length, pack in reversed(steps):
        if not before >> best & 1:
            taken[length] += pack
            best -= pack * length
    return taken


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Per length of one source: how often every document is taken, and how many documents once more."""
    size, target = int((rows["size"] * rows["n"]).sum()), round(float(rows["target"].iloc[0]))
    repeats = min(MOST_REPEATS, target // size) if size else 0
    counts = dict(zip(rows["size"].tolist(), rows["n"].tolist()))
    extra = closest_subset(counts, target - repeats * size) if repeats < MOST_REPEATS else {}
    rows = rows[["source_key", "size", "n"]].assign(repeats=repeats)
    return rows.assign(extra=[extra.get(length, 0) for length in rows["size"]])


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = SEED,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row; taken is the number of words the mix takes of it, repeats counted.

    Sizes are words, null and empty texts have none and are taken with 0. A null source is a source, the last one. Rows are told
    apart by a hash of id and text; wholly equal rows are interchangeable, and reruns agree. An empty table gives no rows.
    The sources are listed on the driver, one row each; nothing else is.
    """
    source = F.col(source_column).cast("string")
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(
        F.col(id_column).alias("id"),
        source.alias("source"),
        F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)).alias("source_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_column), text).alias("order"),
    )
    base = materialize(base)
    lengths = materialize(base.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = lengths.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")).collect()
    per_source.sort(key=lambda r: (r["source_key"][0] == "0", r["source_key"]))
    shares = targets([r["source_size"] for r in per_source], weights)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r["source_key"], r["source_size"], t) for r, t in zip(per_source, shares)], "source_key string, source_size long, target double")
    fitted = lengths.join(plan, "source_key").groupBy("source_key").applyInPandas(_fit, "source_key string, size long, n long, repeats long, extra long")
    fitted = materialize(fitted)
    chunks = max(1, min(MOST_CHUNKS, sum(r["n"] for r in per_source) // CHUNK_ROWS))
    keys = ["source_key", "size", "chunk"]
    dealt = base.withColumn("chunk", F.pmod(F.shiftright("order", 8), F.lit(chunks)))
    # Lengths of which only some documents are taken once more: how many in each chunk, the first chunks first.
    partial = fitted.filter("extra > 0 and extra < n")
    there = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("here")).join(partial, ["source_key", "size"])
    before = F.expr("sum(here) over (partition by source_key, size order by chunk rows between unbounded preceding and 1 preceding)")
    quota = there.withColumn("quota", F.least(F.greatest(F.col("extra") - F.coalesce(before, F.lit(0)), F.lit(0)), F.col("here")))
    quota = materialize(quota.select(*keys, "quota"))
    # The quotas grow with the rows; a merge join has the partitioning that the ranks need anyway.
    ranked = dealt.join(quota.hint("merge"), keys).withColumn("rank", F.expr("row_number() over (partition by source_key, size, chunk order by order, id)"))
    some = ranked.withColumn("more", (F.col("rank") <= F.col("quota")).cast("long")).drop("quota", "rank", "chunk")
    plain = fitted.filter("extra = 0 or extra = n")
    others = base.join(plain.select("source_key", "size", (F.col("extra") > 0).cast("long").alias("more")), ["source_key", "size"])
    repeats = fitted.groupBy("source_key").agg(F.max("repeats").alias("repeats"))
    return (
        some.select("id", "source", "source_key", "size", "more")
        .unionByName(others.select("id", "source", "source_key", "size", "more"))
        .join(materialize(plan.join(repeats, "source_key")), "source_key")
        .select(
            F.col("id").alias(id_column),
            "source",
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("repeats") + F.col("more"))).alias("taken"),
        )
    )
