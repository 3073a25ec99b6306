"""Exact order statistics of many columns at once, digit by digit."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.predicates import col_named, number_or_null
from stayline.session import ship_package
from stayline.sources.tables import materialize

KEY_BITS = 64
#: Bits settled by a pass: six passes, and 16 kB of counts per column and rank in a task.
DIGIT_BITS = 11


def order_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the doubles; both zeros are the same."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def key_value(key: int) -> float:
    """The double with this order key."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def select_ranks(df: DataFrame, wanted: list[tuple[int, int]], sizes: list[int]) -> dict[tuple[int, int], float]:
    """The values at the (column number, rank from 0) of `wanted`; gaps are skipped. `sizes` is each column's number of values.

    A double's bits, put in order, are a number of 64 bits. A pass counts the next digit of the values whose leading digits are
    those of the wanted value, for all columns and ranks at once: every task fills one histogram per column and prefix,
    the histograms are added up, and a running sum over a histogram's bins finds the bin of the rank. So the
    number of passes is fixed, whatever the values, their ties and the number of columns, and one small row
    per wanted rank reaches the driver. `df` is read in every pass and should be stored; its columns are doubles.
    """
    if any(not 0 <= rank < sizes[column] for column, rank in wanted):
        raise ValueError("a rank outside of its column")
    ship_package(df.sparkSession)
    prefixes = {place: 0 for place in wanted}
    left = {place: place[1] for place in wanted}
    settled = 0
    while settled < KEY_BITS and wanted:
        width = min(DIGIT_BITS, KEY_BITS - settled)
        lines = {}
        for (column, _), prefix in prefixes.items():
            lines.setdefault((column, prefix), len(lines))
        counted = df.mapInPandas(_digit_counter(lines, settled, width), "line int, digit int, n long")
        bins = counted.groupBy("line", "digit").agg(F.sum("n").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(W.partitionBy("line").orderBy("digit")))
        asked = [(lines[place[0], prefixes[place]], place[0], place[1], left[place]) for place in wanted]
        ranks = df.sparkSession.createDataFrame(asked, "line int, column int, rank long, left long")
        # A histogram has at most 2^DIGIT_BITS bins, a line at most a few ranks.
        inside = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        for row in upto.join(F.broadcast(ranks), "line").filter(inside).collect():
            place = (row["column"], row["rank"])
            prefixes[place] = prefixes[place] << width | row["digit"]
            left[place] -= row["upto"] - row["n"]
        settled += width
    return {place: key_value(prefix) for place, prefix in prefixes.items()}


def _digit_counter(lines: dict[tuple[int, int], int], settled: int, width: int):
    """Counts, in one task, of the digit after the `settled` leading bits, per (column, prefix)."""

    by_column: dict[int, list[tuple[int, int]]] = {}
    for (column, prefix), line in lines.items():
        by_column.setdefault(column, []).append((prefix, line))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(lines), 1 << width), np.int64)
        for batch in batches:
            for column, asked in by_column.items():
                values = batch.iloc[:, column].to_numpy(dtype=float)
                keys = order_keys(values[~np.isnan(values)])
                digits = (keys >> np.uint64(KEY_BITS - settled - width) & np.uint64((1 << width) - 1)).astype(np.int64)
                leading = keys >> np.uint64(KEY_BITS - settled) if settled else np.zeros(len(keys), np.uint64)
                for prefix, line in asked:
                    totals[line] += np.bincount(digits[leading == np.uint64(prefix)], minlength=1 << width)
        line, digit = np.nonzero(totals)
        yield pd.DataFrame({"line": line.astype(np.int32), "digit": digit.astype(np.int32), "n": totals[line, digit]})

    return count


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5) -> dict[str, float | None]:
    """Exact quantiles of each column (linear between the two neighbours; nulls and NaN skipped, infinities are values).

    None for a column without values. The columns are written once, as doubles; then `select_ranks` finds both neighbours of all
    columns together.
    """
    if not columns:
        return {}
    names = [f"_{i}" for i in range(len(columns))]
    plain = [number_or_null(col_named(c).cast("double")).alias(n) for c, n in zip(columns, names)]
    stored = materialize(df.select(*plain))
    sizes = list(stored.agg(*[F.count(n).alias(n) for n in names]).first())
    places = {i: (n - 1) * q for i, n in enumerate(sizes) if n}
    wanted = {(i, rank) for i, place in places.items() for rank in {floor(place), min(floor(place) + 1, sizes[i] - 1)}}
    values = select_ranks(stored, sorted(wanted), sizes)
    found: dict[str, float | None] = dict.fromkeys(columns)
    for i, place in places.items():
        rank, share = floor(place), place - floor(place)
        low = values[i, rank]
        high = values[i, rank + 1] if share else low
        # Equal infinities have no difference.
        found[columns[i]] = low if low == high else low + (high - low) * share
    return found
