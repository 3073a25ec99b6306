"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

One pass encodes every text and counts documents by length, with partial sums in every task. Suffix sums over the lengths
then give, for every context limit, the documents and tokens at or above it and the tokens left if all are cut to it. They
run inside blocks of lengths, with one short sum over the blocks, so that no task holds the whole histogram.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import arrow_map
from stayline.sources.tables import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """Built once a worker."""
    lines = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def histogram(docs: DataFrame, text_column: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs) of all rows; null and empty texts have 0 tokens; special tokens are ordinary text.

    The vocabulary is read on the driver and sent along, so executors need not have the file.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks.value, pattern)
        counts: Counter = Counter()
        for batch in batches:
            counts.update(len(encoder.encode_ordinary(t.as_py() or "")) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n"])

    partial = arrow_map(docs.select(F.col(text_column).alias("text")), scan, "n_tokens long, n long")
    return partial.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(n_tokens, n_docs, docs_from, tokens_from, truncated_total) for every length that occurs.

    docs_from and tokens_from are the documents of that length or more and their tokens; truncated_total is the number of
    tokens left of the whole corpus if every document is cut to that length.
    """
    rows = materialize(counts.withColumn("block", F.floor(F.col("n_tokens") / block)))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("block", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("later_tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(later, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("later_docs") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("later_tokens") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_from"),
        "total",
    )
    cut = F.col("total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")
    return joined.select("n_tokens", "n_docs", "docs_from", "tokens_from", cut.alias("truncated_total"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> dict[int, int]:
    """Tokens left at each context limit: the total below it, and the limit once for every document at or above it."""
    total = sums.agg(F.max("tokens_from")).first()[0] or 0
    out = {}
    for limit in limits:
        reached = sums.filter(F.col("n_tokens") >= limit).orderBy("n_tokens").select("docs_from", "tokens_from").first()
        docs, tokens = reached or (0, 0)
        out[limit] = total - tokens + docs * limit
    return out


def quantiles(sums: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The smallest length that at least that share of the documents does not exceed; None for an empty corpus."""
    total = sums.agg(F.max("docs_from")).first()[0]
    out: dict[float, int | None] = {}
    for share in shares:
        upto = F.lit(total) - F.col("docs_from") + F.col("n_docs")
        out[share] = None if total is None else sums.filter(upto >= F.lit(share) * total).agg(F.min("n_tokens")).first()[0]
    return out


def length_report(docs: DataFrame, text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The suffix sums of the histogram of `docs`; an empty table gives no rows, and repeated rows count as often as they are there."""
    return suffix_sums(histogram(docs, text_column, vocabulary))
