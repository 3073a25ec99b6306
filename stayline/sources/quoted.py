"""CSV with line breaks inside quoted fields, read by many tasks a file.

The file is read as lines, in byte ranges. Whether a line begins inside quotes follows from the number of quotes before it:
one pass counts them per byte range, a running sum over the ranges of a file gives the state at the start of each, and each range
then finds its records by itself. A record that crosses ranges is put together from its pieces; all others never leave
their task. Only the ranges that begin inside quotes are known to all tasks, eight bytes for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayline.session import ship_package
from stayline.sources.tables import materialize

QUOTE = '"'
#: What a row of `pieces` is: a whole record, what a range has before its first record, and its last record, which may go on.
WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "file string, start long, kind int, first boolean, text string"
_BATCH_SETTING, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, range, line): the lines in order inside each byte range; carriage returns stay."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    return lines.select(
        F.col(at[0]).alias("file"), F.col(at[1]).alias("start"), F.xxhash64(*at).alias("range"), F.col("value").alias("line")
    )


def open_ranges(lines: DataFrame) -> np.ndarray:
    """The ranges that begin inside quotes, sorted; eight bytes a range, and a range is a task's share of a file.

    A file whose quotes do not pair off raises.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit(QUOTE), F.lit("")))
    counts = materialize(lines.groupBy("file", "start", "range").agg(F.sum(quotes).alias("quotes")))
    odd = counts.groupBy("file").agg(F.sum("quotes").alias("quotes")).filter("quotes % 2 = 1").limit(1).collect()
    if odd:
        raise ValueError(f"quotes that do not pair off in {odd[0]['file']}")
    before = F.sum("quotes").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    inside = counts.withColumn("before", before).filter("before % 2 = 1").select("range")
    return np.sort(np.array([r["range"] for r in inside.collect()], np.int64))


def pieces(lines: DataFrame, opened: np.ndarray, whole: bool) -> DataFrame:
    """PIECES of all ranges: the whole records, or else the heads and tails. The first record of a file, its header, is marked."""
    spark = lines.sparkSession
    ship_package(spark)
    if int(spark.conf.get(_BATCH_SETTING).removesuffix("b")) > _BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{_BATCH_BYTES}b")
    shared = spark.sparkContext.broadcast(opened)
    names = ["file", "start", "kind", "first", "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        at: tuple[str, int] | None = None
        inside, held, started, seen = False, [], False, 0
        out: list[tuple] = []

        def flush(kind: int) -> None:
            if (kind == WHOLE) == whole and (held or kind == TAIL):
                out.append((*at, kind, started and at[1] == 0 and seen == 1, "\n".join(held)))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def ended(text: pa.Array, begins: np.ndarray) -> pa.RecordBatch:
            """The records that begin at these lines but for the last, whose end is not known; joined without a Python string each."""
            n = len(begins) - 1
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), text)
            marked = np.zeros(n, bool)
            marked[0] = at[1] == 0 and seen == 0
            same = [pa.repeat(pa.scalar(v, t), n) for v, t in zip((*at, WHOLE), (pa.string(), pa.int64(), pa.int32()))]
            return pa.RecordBatch.from_arrays([*same, pa.array(marked), pc.binary_join(lists, "\n").cast(pa.string())], names)

        for batch in batches:
            ranges = batch.column(2).to_numpy(zero_copy_only=False)
            line = batch.column(3)
            quotes = pc.count_substring(line, QUOTE).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else []
            for low, high in zip(begins, [*begins[1:], len(ranges)]):
                own = (batch.column(0)[int(low)].as_py(), batch.column(1)[int(low)].as_py())
                if own != at:
                    if at is not None:
                        flush(TAIL if started else HEAD)
                    place = np.searchsorted(known, ranges[low])
                    inside = bool(place < len(known) and known[place] == ranges[low])
                    at, held, started, seen = own, [], False, 0
                states = (np.cumsum(quotes[low:high]) + inside) % 2 == 1
                text = line.slice(low, high - low)
                first = np.flatnonzero(~np.concatenate([[inside], states[:-1]]))
                # Lines up to the next start of a record belong to the open one.
                held += text.slice(0, first[0] if len(first) else None).to_pylist()
                if len(first):
                    if held or started:
                        flush(WHOLE if started else HEAD)
                    if whole and len(first) > 1:
                        yield ended(text, first)
                    held, started, seen = text.slice(first[-1]).to_pylist(), True, seen + len(first)
                inside = bool(states[-1])
            yield taken()
        if at is not None:
            flush(TAIL if started else HEAD)
        yield taken()

    return lines.mapInArrow(scan, PIECES)


def _joined(parts: DataFrame) -> DataFrame:
    """(first, text) of the records that a range ends with, with what the next ranges have of them."""
    order = W.partitionBy("file").orderBy("start", "kind")
    numbered = parts.withColumn("record", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    grouped = numbered.groupBy("file", "record").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("parts")
    )
    return grouped.select("first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def load_quoted_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header line a file, quotes doubled inside quoted fields, and line breaks in them kept; an empty field is null.

    Large files are cut into byte ranges as any text is (`spark.sql.files.maxPartitionBytes`), one task each; compressed files
    are one range. Blank lines between records are skipped. Quotes that do not pair off in a file raise at once; a record with
    a malformed field, or with too few or too many of them, fails the query that reads it. A quote inside a field without quotes
    cannot be told from a quoted field's, and is an error of the file.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = _lines(spark, path)
    opened = open_ranges(lines)
    crossing = _joined(materialize(pieces(lines, opened, whole=False)))
    records = pieces(lines, opened, whole=True).select("first", "text").unionByName(materialize(crossing))
    # The pattern goes through a whole text, so it only sees those that it can match.
    text = F.when(F.substring("text", -2, 2).contains("\r"), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))
    filled = records.filter(~F.col("first")).select(text.alias("text")).filter(F.trim("text") != "")
    options = {"mode": "FAILFAST", "escape": QUOTE, "multiLine": "true"}
    return filled.select(F.from_csv("text", fields.toDDL(), options).alias("r")).select("r.*")
