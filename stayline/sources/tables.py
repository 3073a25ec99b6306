"""Readers, writers, materialised results and key checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from stayline.functions.predicates import col_named, number_or_null
from stayline.session import work_path
from stayline.sources.schemas import CLUSTERING, MULTI_LINE, NOT_NULL, PRIMARY_KEY, schema_of


def load_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with a header row; an empty field is null.

    A malformed field fails the query that reads it. Spark parses only the columns a query uses, so a
    narrow query or a count does not see errors in the others: `ingest_table`, which writes every column,
    checks every field. `multi_line` files are read whole, one task each; `load_quoted_csv` deals a file out to many.
    """
    return spark.read.schema(schema).csv(
        path, header=True, mode="FAILFAST", escape='"', multiLine=multi_line
    )


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the ten base tables from its CSV file, NaN read as missing; only the fields that are read are checked."""
    if table in MULTI_LINE:
        from stayline.sources.quoted import load_quoted_csv

        return nan_to_null(load_quoted_csv(spark, path, schema_of(table)))
    return nan_to_null(load_csv(spark, path, schema_of(table)))


def ingest_table(spark: SparkSession, csv_path: str, table: str, out: str, files: int | None = None) -> DataFrame:
    """CSV to Parquet, once; every field is parsed, and a malformed one fails the load.

    Event tables are laid out by join key and time so that scans skip row groups. The
    layout is a range partitioning over key, time and row id: a key that holds a large
    share of the rows spreads over several files instead of one.
    """
    df = load_table(spark, csv_path, table)
    if table in CLUSTERING:
        order = [*CLUSTERING[table], *PRIMARY_KEY]
        df = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
        df = df.sortWithinPartitions(*order)
    return materialize(df, out)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            number_or_null(col_named(f.name)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else col_named(f.name)
            for f in df.schema.fields
        ]
    )


def save_dataset(df: DataFrame, path: str) -> None:
    """Replaces what is at `path`; missing folders are made."""
    df.write.mode("overwrite").parquet(path)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the result and reads it back, so that later plans start from the files.

    Without a path the files go to a fresh folder under the shared work folder.
    """
    spark = df.sparkSession
    target = path or work_path(spark, "table")
    save_dataset(df, target)
    return spark.read.schema(df.schema).parquet(target)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str = "") -> DataFrame:
    """Parquet at `path`, or no rows if there is nothing there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int = 1,
    options: Mapping[str, str] | None = None,
    one_connection: bool = False,
) -> DataFrame:
    """A relation or query of another database.

    With a partition column the read is split into ranges, one connection each; filters
    and the column list are pushed to the database by Spark. Without one a single task reads it all,
    which must be asked for by `one_connection`.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if partition_column is None and not one_connection:
        raise ValueError("give a partition column, or ask for one connection")
    reader = spark.read.format("jdbc").options(url=url, **(options or {}))
    if query is not None and partition_column is None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table if query is None else f"({query}) q")
    if partition_column is not None:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def run_sql(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A caller's SQL text over frames passed by name, as `{name}` in the text."""
    return spark.sql(query, **(views or {}))


def load_inputs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three inputs of the feature build, lazily, from one folder of Parquet sets."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("labs", "vitals", "cohort")}


def key_violations(df: DataFrame, keys: list[str], not_null: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, are null, or have nulls in a required column."""
    key_null = F.lit(False)
    for key in keys:
        key_null = key_null | col_named(key).isNull()
    missing = key_null
    for name in not_null or []:
        missing = missing | col_named(name).isNull()
    return (
        df.groupBy(*[col_named(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_null_rows"))
        .filter((F.col("n_rows") > 1) | (F.col("n_null_rows") > 0))
    )


def table_violations(df: DataFrame, table: str) -> DataFrame:
    """The declared constraints of one base table."""
    return key_violations(df, PRIMARY_KEY, NOT_NULL.get(table))


def save_model(model, path: str) -> None:
    """Any fitted Spark ML model or pipeline, replacing what is at `path`."""
    model.write().overwrite().save(path)


def load_model(reader, path: str):
    """`reader` is the model class, such as PipelineModel; a missing path raises."""
    return reader.load(path)


def save_names(spark: SparkSession, names: list[str], path: str) -> None:
    """The ordered feature names as one text file, one name per line."""
    rows = spark.createDataFrame([(n,) for n in names], "value STRING").coalesce(1)
    rows.write.mode("overwrite").text(path)


def load_names(spark: SparkSession, path: str) -> list[str]:
    """Names in file order; blank lines are skipped."""
    rows = spark.read.text(path, wholetext=False).coalesce(1).collect()
    return [row.value.strip() for row in rows if row.value.strip()]
