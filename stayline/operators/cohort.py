"""Building blocks of a cohort: code selection, first stay, stay length, age, outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.predicates import code_in_range, col_named, lasts_at_most, matches_any


def select_codes(
    dictionary: DataFrame,
    code: str,
    title: str,
    code_range: tuple[int, int],
    patterns: list[str],
    digits: int = 3,
) -> DataFrame:
    """Dictionary rows whose code lies in the range and whose title matches a pattern."""
    return dictionary.filter(
        code_in_range(col_named(code), *code_range, digits=digits) & matches_any(col_named(title), patterns)
    )


def first_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of every key in the given order; name a unique column last to settle ties.

    An aggregate instead of a ranking: each task keeps one row per key before the shuffle,
    so a key with very many rows costs no more than any other. Nulls sort last, and rows that
    are equal in the order are settled by their other columns.
    """
    order = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    # The smallest (order, other columns) is the first row itself.
    parts = [
        part
        for i, c in enumerate(order)
        for part in (col_named(c).isNull().alias(f"_{i}_missing"), col_named(c))
    ]
    row = F.min(F.struct(*parts, *[col_named(c) for c in rest])).alias("_first")
    first = df.groupBy(*[col_named(k) for k in keys]).agg(row)
    return first.select(
        *[col_named(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns]
    )


def short_stays(stays: DataFrame, start: str, end: str, hours: float) -> DataFrame:
    """Stays of at most `hours`; those without an end are left out."""
    return stays.filter(lasts_at_most(col_named(start), col_named(end), hours))


def one_row_per_stay(cohort: DataFrame, stay: str, code: str) -> DataFrame:
    """The cohort at stay grain: of several codes the smallest is kept."""
    return first_per_key(cohort, [stay], [code])
