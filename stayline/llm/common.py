"""What the operators of this subpackage share: tables, row numbers, digests, held-out rows and Arrow text buffers.

Rows are told apart by a number given while they are written (`numbered`), never by `doc_id`, which may be null or repeated.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stayline.session import ship_package
from stayline.sources.tables import materialize

HELD_OUT_REMAINDER = 2
FOLDS = 4


#: Texts are long and of very unlike length: a batch is bounded by its bytes, so that a task holds little of them at once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that no model learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT_REMAINDER


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """The rows, written once, with a number of their own.

    The number is stored beside the row by the task that made it, so every later read sees the same pairs.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_map(df: DataFrame, scan, schema) -> DataFrame:
    """`mapInArrow`, with this package on the workers and batches of at most BATCH_BYTES, or less if the session says so."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get(BATCH_SETTING).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(scan, schema)


def release_memory() -> None:
    """Returns freed memory of Arrow and of the C library to the system, where that can be done: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library: it trims by itself or not at all.
        return


def map_batches(df: DataFrame, scan, fields: list[StructField]) -> DataFrame:
    """`arrow_map` over all columns of `df` in their order, whatever their names hold; columns are known by place."""
    inner = [f"_{i}" for i in range(len(fields))]

    def placed(batches):
        for batch in scan(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, inner)

    schema = StructType([StructField(name, f.dataType, True) for name, f in zip(inner, fields)])
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return arrow_map(plain, placed, schema).toDF(*[f.name for f in fields])


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once a row however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) made of the row's values: the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each row begins (one more entry than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    size = np.dtype(np.int64 if wide else np.int32)
    at = np.frombuffer(offsets, size)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_bytes(column: pa.Array):
    """The UTF-8 bytes of each row in turn; null is empty."""
    data, at = text_buffer(column)
    view = memoryview(np.ascontiguousarray(data))
    for i in range(len(at) - 1):
        yield bytes(view[at[i] : at[i + 1]])
