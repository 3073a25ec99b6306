"""A training corpus out of `documents`: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of documents; the last returns what
the mix takes of each document. A row is never looked up by position or file, so a lost executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayline.llm import decontaminate, mixing, nearcopies, quality, secrets
from stayline.llm.common import table
from stayline.sources.tables import materialize


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a probability under 0.7 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup by SimHash and by five-word shingle sets at 0.8 or more: the row of the smallest doc_id of every group stays."""
    return nearcopies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that share ten words in a row, or a whole shorter item, with the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def strike_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: spans are replaced by a mark, and the documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: one row a document, with the words that the mix takes of it; 0 leaves it out."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", strike_secrets),
    ("mixing to target weights", mix_sources),
]
#: The stages have no SQL: fitted weights and XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTRY = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
