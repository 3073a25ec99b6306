"""Loads that are checked before anyone can read them, and replaced by one switch.

A published table is a folder of versions and a log of numbered pointers. A load writes a new version beside the others, checks
keys and required columns on what was written, and then creates the next pointer: a file that must not be there yet, so of two
loads that race one fails, and a reader sees either the old version or the new one, whole. A load that fails in any way leaves
the table as it was. Readers take the version that the highest pointer names and keep it while they run, for old versions stay
until `drop_old_versions`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stayline.sources.schemas import CLUSTERING, NOT_NULL, PRIMARY_KEY
from stayline.sources.tables import key_violations, load_table, read_or_empty, save_dataset

POINTERS = "_pointers"


class LoadError(ValueError):
    """The new version breaks its keys; the table still is what it was."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _pointers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _files(spark, f"{path}/{POINTERS}")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def _version_of(spark: SparkSession, path: str, number: int) -> str:
    fs, file = _files(spark, f"{path}/{POINTERS}/{number:010d}")
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, number: int, version: str) -> None:
    """Creates pointer `number`: written beside, then given its name, which fails if that is taken."""
    fs, draft = _files(spark, f"{path}/{POINTERS}/draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    _, file = _files(spark, f"{path}/{POINTERS}/{number:010d}")
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(file), options)
    except Exception as err:
        fs.delete(draft, False)
        raise LoadError(f"another load was published to {path} meanwhile") from err


def published_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that readers see now."""
    numbers = _pointers(spark, path)
    return f"{path}/{_version_of(spark, path, numbers[-1])}" if numbers else None


def read_published(spark: SparkSession, path: str, schema: StructType | str = "") -> DataFrame:
    """The published version, or no rows if nothing was published."""
    version = published_version(spark, path)
    return read_or_empty(spark, version or f"{path}/none", schema)


def publish_table(
    df: DataFrame,
    path: str,
    keys: list[str] | None = None,
    not_null: list[str] | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Writes `df` as a new version, checks it, and makes it the table; the rows of the new version.

    `keys` must name each row and be filled, and so must `not_null` be. Keys are counted by partial aggregates over the written
    files, so a failed check names up to five of them in its LoadError. Without keys nothing is checked.
    """
    spark = df.sparkSession
    number = (_pointers(spark, path) or [0])[-1] + 1
    version = f"version-{uuid.uuid4().hex}"
    target = f"{path}/{version}"
    try:
        if partition_by:
            df.write.partitionBy(*partition_by).parquet(target)
        else:
            save_dataset(df, target)
        written = spark.read.schema(df.schema).parquet(target)
        if keys:
            wrong = key_violations(written, keys, not_null).limit(5).collect()
            if wrong:
                named = [", ".join(f"{k}={row[k]}" for k in keys) for row in wrong]
                raise LoadError(f"repeated keys or missing values in the new version of {path}: {'; '.join(named)}")
        _point(spark, path, number, version)
    except Exception:
        # Whatever went wrong, in Spark or in the check: nothing of it stays.
        fs, folder = _files(spark, target)
        fs.delete(folder, True)
        raise
    return written


def publish_csv(spark: SparkSession, csv_path: str, table: str, path: str, files: int | None = None) -> DataFrame:
    """One of the ten base tables from CSV to a published version, laid out as `ingest_table` does, its declared keys checked."""
    df = load_table(spark, csv_path, table)
    if table in CLUSTERING:
        order = [*CLUSTERING[table], *PRIMARY_KEY]
        df = (df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    return publish_table(df, path, PRIMARY_KEY, NOT_NULL.get(table))


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all but the `keep` newest published versions, and what failed loads left; how many versions went.

    Not while a load runs, nor while readers of an old version do.
    """
    if keep < 1:
        raise ValueError("the published version stays")
    numbers = _pointers(spark, path)
    kept = {_version_of(spark, path, n) for n in numbers[-keep:]}
    fs, folder = _files(spark, path)
    gone = 0
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.startswith("version-") and name not in kept:
            fs.delete(status.getPath(), True)
            gone += 1
    for number in numbers[:-keep]:
        fs.delete(_files(spark, f"{path}/{POINTERS}/{number:010d}")[1], False)
    return gone
