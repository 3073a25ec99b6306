"""Event tables stored in buckets of their join key, so that joins on it do not shuffle them again.

A bucket is a hash of the key and of the stretch of time that an event falls in, as long as the window it is joined with: a key
with very many events spreads over its stretches. What the files are is written beside them, so any session can read them
as buckets, without a shared catalog.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayline.functions.predicates import col_named, hour_number

SPEC = "_buckets.json"
STRETCH = "_stretch"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _spec_file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SPEC}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _table(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """The files as a bucketed table of this session; the same files have one name."""
    name = f"stored_{spec['made']}"
    keys = ", ".join(_quoted(k) for k in [*spec["keys"], STRETCH])
    fields = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in StructType.fromJson(spec["schema"]).fields)
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
        f"INTO {spec['buckets']} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def save_bucketed(df: DataFrame, path: str, keys: list[str], time: str, buckets: int, hours: int = 48) -> DataFrame:
    """Writes events in `buckets` files by `keys` and stretches of `hours`, each sorted, and reads them back as buckets.

    Replaces what is at `path`. The stretch is a column of the stored table. Rows with a null key or time are kept, and
    meet no window. Give a bucket what one task should read, such as 128 MB.
    """
    spark = df.sparkSession
    if STRETCH in df.columns:
        raise ValueError(f"the stored table has a column {STRETCH} of its own")
    stored = df.withColumn(STRETCH, F.floor(hour_number(col_named(time)) / hours).cast("long"))
    by = [*keys, STRETCH]
    draft = spark.sql("SELECT replace(uuid(), '-', '') AS n").first()["n"]
    # One task writes one bucket: a shuffle by the same hash, and no small files.
    dealt = stored.repartition(buckets, *[col_named(k) for k in by])
    dealt.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(f"draft_{draft}")
    spark.sql(f"DROP TABLE draft_{draft}")
    spec = {"keys": keys, "time": time, "buckets": buckets, "hours": hours, "made": draft, "schema": stored.schema.jsonValue()}
    fs, file = _spec_file(spark, path)
    stream = fs.create(file, True)
    try:
        stream.write(bytearray(json.dumps(spec).encode()))
    finally:
        stream.close()
    return _table(spark, path, spec)


def bucket_spec(spark: SparkSession, path: str) -> dict:
    """How the table at `path` is stored; raises if it is not stored in buckets."""
    fs, file = _spec_file(spark, path)
    if not fs.exists(file):
        raise FileNotFoundError(f"no {SPEC} at {path}")
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of `save_bucketed`, in this or any later session."""
    return _table(spark, path, bucket_spec(spark, path))
