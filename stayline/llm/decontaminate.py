"""Benchmark decontamination by winnowing.

Every window of ten words has its smallest hash of five consecutive words selected. Two texts that share ten words in a
row select the same five of them, so joining the selected hashes of documents and benchmark items finds every shared span
of ten words or more. Each selected hash travels with the words around it, and a hit is extended over them, word by word.
Items of fewer than ten words count as a whole: documents offer all their runs of such a length.

Hashes that no benchmark item has are dropped where they arise, by a bit table of fixed size (`FILTER_BITS`); what passes it
by chance does not survive the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from stayline.llm.common import arrow_map, fresh, map_batches, numbered, text_buffer
from stayline.llm.tokens import SEPARATORS, ascii_fold, byte_class, hash_words, joined, mixed
from stayline.sources.tables import materialize

WINDOW = 10
GRAM = 5
FILTER_BITS = 24
PIECE = 500
MARK = StructType(
    [
        StructField("key", LongType()),
        StructField("at", IntegerType()),
        StructField("pivot", IntegerType()),
        StructField("size", IntegerType()),
        StructField("words", StringType()),
    ]
)


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, the ends cut off."""
    total = max(0, len(words) - size + 1)
    out = words[:total]
    for i in range(1, size):
        out = joined(out, words[i : i + total])
    return mixed(out + np.uint64(size))


def selected(words: np.ndarray, rows: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the grams with the smallest hash of some window inside one row; all that tie."""
    grams = runs_of(words, gram)
    span = window - gram + 1
    total = len(grams) - span + 1
    if total <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = grams[:total].copy()
    for i in range(1, span):
        np.minimum(low, grams[i : i + total], out=low)
    end = np.repeat(rows[1:], np.diff(rows))
    inside = np.arange(total) + window <= end[:total]
    chosen = np.zeros(len(grams), bool)
    for i in range(span):
        chosen[i : i + total] |= inside & (grams[i : i + total] == low)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def whole_runs(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all runs of `size` words inside one row."""
    hashes = runs_of(words, size)
    end = np.repeat(rows[1:], np.diff(rows))
    at = np.flatnonzero(np.arange(len(hashes)) + size <= end[: len(hashes)])
    return at, hashes[at]


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word = bits[(keys >> np.uint64(64 - FILTER_BITS + 6)).astype(np.int64)]
    return (word >> (keys & np.uint64(63))) & np.uint64(1) == 1


def marks(data: np.ndarray, at: np.ndarray, bits: np.ndarray | None, sizes: list[int], window: int, items: bool) -> tuple[np.ndarray, pa.ListArray]:
    """(words of each row, its marks). items: only rows shorter than the window give whole runs, and of their length."""
    words, first, _, rows = hash_words(data, at, byte_class(SEPARATORS), ascii_fold())
    lengths = np.diff(rows)
    found = [(*selected(words, rows, window), 0)]
    for size in range(1, window) if items else sizes:
        places, keys = whole_runs(words, rows, size)
        if items:
            own = np.repeat(lengths, lengths)[places] == size
            places, keys = places[own], keys[own]
        found.append((places, keys, size))
    places = np.concatenate([f[0] for f in found])
    keys = np.concatenate([f[1] for f in found])
    sizes_ = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    if bits is not None:
        ok = passes(bits, keys)
        places, keys, sizes_ = places[ok], keys[ok], sizes_[ok]
    order = np.argsort(places, kind="stable")
    places, keys, sizes_ = places[order], keys[order], sizes_[order]
    row = np.searchsorted(rows, places, side="right") - 1
    short = sizes_ > 0
    around = window - GRAM
    low = np.where(short, places, np.maximum(places - around, rows[row]))
    high = np.where(short, places + sizes_, np.minimum(places + GRAM + around, rows[row + 1]))
    fold, gap = ascii_fold(), byte_class(SEPARATORS) == 0
    texts = []
    for a, b in zip(low, high):
        part = fold[data[first[a] : (first[b] if b < rows[-1] else len(data))]]
        part[gap[part]] = 32
        texts.append(b" ".join(part.tobytes().split()[: b - a]).decode())
    base = rows[row]
    arrays = [
        pa.array(keys.view(np.int64)),
        pa.array((low - base).astype(np.int32)),
        pa.array((places - low).astype(np.int32)),
        pa.array(sizes_.astype(np.int32)),
        pa.array(texts, pa.string()),
    ]
    ends = np.searchsorted(places, rows).astype(np.int32)
    return lengths, pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, names=MARK.names))


def marked(docs: DataFrame, text_column: str, keep: list[str], bits, sizes: list[int], window: int, items: bool) -> tuple[DataFrame, str, str]:
    """The columns `keep` with the number of words and the marks of every row, and the names of these two columns."""
    n_words, found = fresh(docs, "n_words"), fresh(docs, "marks")
    # Each column once, and the text last, so that neither names with dots nor repeats matter.
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").alias(fresh(docs, "scanned")))
    fields = [docs.schema[c] for c in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else bits.value
        for batch in batches:
            for low in range(0, batch.num_rows, PIECE):
                piece = batch.slice(low, PIECE)
                lengths, lists = marks(*text_buffer(piece.column(len(keep))), table, sizes, window, items)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(lengths, pa.int64()), lists], [*keep, n_words, found])

    added = [StructField(n_words, LongType()), StructField(found, ArrayType(MARK))]
    return map_batches(slim, scan, [*fields, *added]), n_words, found


def item_marks(benchmark: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """(key, item_id, pivot, size, words) of all benchmark items, written once; items without words give none."""
    rows, _, found = marked(benchmark, text_column, [id_column], None, [], window, items=True)
    flat = rows.select(F.col(id_column).alias("item_id"), F.explode(found).alias("m"))
    return materialize(flat.select("m.key", "item_id", "m.pivot", "m.size", "m.words").distinct())


def bit_table(items: DataFrame) -> np.ndarray:
    """One bit per 2^-FILTER_BITS of the hashes; at most 2^(FILTER_BITS - 6) numbers come to the driver."""
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = items.groupBy(F.shiftrightunsigned("key", 64 - FILTER_BITS + 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in words.collect():
        table[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    return table


def extend(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Pairs of marks with one key -> the words of the document that the item shares, if they are enough."""
    for batch in batches:
        columns = batch.to_pydict()
        out = []
        for row, item, at, dp, dw, ip, iw, size in zip(*(columns[c] for c in ("row", "item_id", "at", "pivot", "words", "item_pivot", "item_words", "size"))):
            if size:
                if dw == iw:
                    out.append((row, item, at, at + size))
                continue
            ours, theirs = dw.split(" "), iw.split(" ")
            if ours[dp : dp + GRAM] != theirs[ip : ip + GRAM]:
                continue
            low, high = 0, GRAM
            while low < min(dp, ip) and ours[dp - low - 1] == theirs[ip - low - 1]:
                low += 1
            while dp + high < len(ours) and ip + high < len(theirs) and ours[dp + high] == theirs[ip + high]:
                high += 1
            if low + high >= window:
                out.append((row, item, at + dp - low, at + dp + high))
        rows = list(zip(*out)) if out else [[], [], [], []]
        kind = batch.schema.field("item_id").type
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], kind), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())],
            ["row", "item_id", "low", "high"],
        )


def hits(rows: DataFrame, found: str, items: DataFrame, window: int) -> DataFrame:
    """(row, item_id, low, high): the words low to high of a row that an item has in the same order, written once."""
    flat = rows.select("row", F.explode(found).alias("m")).select("row", "m.*")
    theirs = items.select("key", "size", "item_id", F.col("pivot").alias("item_pivot"), F.col("words").alias("item_words"))
    pairs = flat.join(theirs, ["key", "size"])
    kind = dict(items.dtypes)["item_id"]
    found_ = arrow_map(pairs, lambda batches: extend(batches, window), f"row long, item_id {kind}, low int, high int")
    return materialize(found_.distinct())


def _prepared(docs, benchmark, keep, text_column, item_column, item_text, window):
    items = item_marks(benchmark, item_column, item_text, window)
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(items))
    sizes = sorted(r["size"] for r in items.filter("size > 0").select("size").distinct().collect())
    rows, n_words, found = marked(docs, text_column, keep, bits, sizes, window, items=False)
    return items, rows, n_words, found


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document row.

    Null or empty texts have no words and no hits. Repeated rows are judged each for itself. Several items of one text are all
    listed, and an item id with several texts once; items with a null id mark words but are neither counted nor listed.
    """
    items, rows, n_words, found = _prepared(docs, benchmark, [id_column], text_column, item_column, item_text, window)
    rows = numbered(rows.select(F.col(id_column).alias("id"), F.col(n_words).alias("n_words"), F.col(found).alias("marks")))
    shared = hits(rows, "marks", items, window)
    spans = shared.select("row", "low", "high").distinct()
    words = spans.select("row", F.explode(F.sequence("low", F.col("high") - 1)).alias("word")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = shared.filter("item_id is not null").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    full = rows.select("row", "id", "n_words").join(words, "row", "left").join(listed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return full.select(
        F.col("id").alias(id_column),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any hit. Only rows with a mark take part in a join; the others pass straight through."""
    items, rows, n_words, found = _prepared(docs, benchmark, docs.columns, text_column, item_column, item_text, window)
    row = fresh(docs, "row")
    rows = numbered(rows, row)
    shared = hits(rows.select(F.col(row).alias("row"), F.col(found).alias("marks")), "marks", items, window)
    marked_rows = rows.filter(F.size(found) > 0).join(shared.select(F.col("row").alias(row)).distinct(), row, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.filter(F.size(found) == 0).select(*columns).unionByName(marked_rows.select(*columns))
