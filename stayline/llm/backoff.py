"""Stupid-backoff language model of the corpus, and the score of every document under it.

Documents are cut into chunks of about a million words (one Arrow batch), kept as a dictionary of word hashes and codes. For each order of
n-gram a chunk sends its distinct n-grams with their counts to the partition of the count table that their hash names; the
partition adds the counts of all chunks and answers each with the totals. So a frequent n-gram is one entry a chunk,
however often it occurs, and no table is ever whole in one place. Answers come back to the chunk in the order of the
hashes, and the chunk sums the logarithms per document.

A document's own counts are taken off before it is scored, so that no text is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from stayline.llm.common import arrow_map, numbered, text_buffer
from stayline.llm.tokens import SEPARATORS, ascii_fold, byte_class, hash_words, joined

#: Counts of words and of pairs; a third order is a parameter, and costs one more exchange of all distinct n-grams.
ORDER = 2
DISCOUNT = 0.4
CHUNK_WORDS = 1_400_000
#: Entries of a partition of the count table, about.
PART_ENTRIES = 1 << 19
MOST_PARTS = 1 << 20


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers of `width` bytes, byte planes apart, compressed: planes of zeros cost next to nothing."""
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def packed_sorted(hashes: np.ndarray) -> bytes:
    """Ascending hashes as their steps, which are short."""
    return packed(np.diff(hashes, prepend=np.uint64(0)), 8)


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, 8), dtype=np.uint64)


def chunked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(chunk, ids, lengths, words, codes, n): some documents in their order, each word a code into the sorted hashes."""
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            sizes = np.diff(text_buffer(batch.column(1))[1])
            while low < batch.num_rows:
                # At most so many bytes as CHUNK_WORDS words of six take, and one document at least.
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), 6 * CHUNK_WORDS, side="right")))
                piece = batch.slice(low, high - low)
                hashes, _, _, rows = hash_words(*text_buffer(piece.column(1)), byte_class(SEPARATORS), ascii_fold())
                words, codes = np.unique(hashes, return_inverse=True)
                arrays = [
                    pa.array([piece.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)),
                    pa.array([np.diff(rows).tolist()], pa.list_(pa.int64())),
                    pa.array([packed_sorted(words)]),
                    pa.array([packed(codes)]),
                    pa.array([len(hashes)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "lengths", "words", "codes", "n"])
                low = high

    schema = StructType([StructField("ids", ArrayType(slim.schema["id"].dataType)), *_fields("lengths array<long>, words binary, codes binary, n long")])
    return numbered(arrow_map(slim, scan, schema), "chunk")


def _fields(ddl: str):
    return StructType.fromDDL(ddl).fields


def grams(hashes: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `order` words inside one row, in their order."""
    lengths = np.diff(rows)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = max(0, len(hashes) - order + 1)
    out = hashes[:total]
    for i in range(1, order):
        out = joined(out, hashes[i : i + total])
    inside = owner[:total] == owner[order - 1 :][:total]
    return out[inside], owner[:total][inside]


def _chunk(words: bytes, codes: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return unpacked_sorted(words)[unpacked(codes)], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def requests(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(size, part, chunk, grams, counts): the distinct n-grams of a chunk, cut by the first `bits` of their hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, rows = _chunk(row["words"], row["codes"], row["lengths"])
                for size in range(1, order + 1):
                    distinct, counts = np.unique(grams(hashes, rows, size)[0], return_counts=True)
                    parts = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
                    begin = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.empty(0, np.int64)
                    ends = np.append(begin[1:], len(parts))
                    arrays = [
                        pa.array(np.full(len(begin), size, np.int32)),
                        pa.array(parts[begin]),
                        pa.array(np.full(len(begin), row["chunk"], np.int64)),
                        pa.array([packed_sorted(distinct[a:b]) for a, b in zip(begin, ends)], pa.binary()),
                        pa.array([packed(counts[a:b]) for a, b in zip(begin, ends)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["size", "part", "chunk", "grams", "counts"])

    return arrow_map(chunks.select("chunk", "words", "codes", "lengths"), scan, "size int, part long, chunk long, grams binary, counts binary")


def answer(part: pa.Table) -> pa.Table:
    """Of one partition of the count table: the totals of each chunk's n-grams, in the order they came in."""
    asked = [unpacked_sorted(g) for g in part.column("grams").to_pylist()]
    counts = np.concatenate([unpacked(c) for c in part.column("counts").to_pylist()]).astype(np.float64)
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(inverse, counts).astype("<u8")[inverse]
    ends = np.cumsum([len(a) for a in asked])[:-1]
    blobs = [packed(t, 8) for t in np.split(totals, ends)]
    return pa.table([part.column("chunk"), part.column("size"), part.column("part"), pa.array(blobs, pa.binary())], names=["chunk", "size", "part", "totals"])


def document_scores(hashes: np.ndarray, rows: np.ndarray, tables: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log scores, n-grams that backed off) of each row.

    tables[k] has the corpus counts of the chunk's sorted distinct runs of k + 1 words. A word scores count / words of the
    other documents; a longer run its count over that of the run without its last word, or, if no other document has it,
    DISCOUNT times the score of the run without its first. A word that no other document has counts as once.
    """
    docs, order = len(rows) - 1, len(tables)
    lengths = np.diff(rows)
    owner = np.repeat(np.arange(docs), lengths)
    n = len(hashes)
    place = np.arange(n) - rows[:-1][owner]
    counts = []
    for size in range(1, order + 1):
        found, own_row = grams(hashes, rows, size)
        distinct, code = np.unique(found, return_inverse=True)
        # Occurrences of the same run in the same document.
        pair = own_row.astype(np.int64) * max(1, len(distinct)) + code
        _, again, own = np.unique(pair, return_inverse=True, return_counts=True)
        left = tables[size - 1][code] - own[again] if len(code) else np.empty(0, np.int64)
        # By the last word of the run; runs that do not fit have no count.
        full = np.zeros(n, np.int64)
        full[np.flatnonzero(place >= size - 1)] = left
        counts.append(full)
    others = np.maximum(total - lengths[owner], 1)
    log_score = np.log(np.maximum(counts[0], 1) / others)
    backed = np.zeros(n, np.int64)
    for size in range(2, order + 1):
        fits = place >= size - 1
        seen = fits & (counts[size - 1] > 0)
        context = np.ones(n, np.int64)
        context[1:] = counts[size - 2][:-1]
        log_score = np.where(seen, np.log(np.maximum(counts[size - 1], 1) / np.maximum(context, 1)), np.where(fits, np.log(DISCOUNT) + log_score, log_score))
        backed += fits & ~seen
    return np.bincount(owner, log_score, docs), np.bincount(owner, backed, docs).astype(np.int64)


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, log_score, per_word, n_backoffs) of every row.

    Words have A-Z in lower case and are runs of letters, digits and characters above ASCII; log_score is the sum of natural
    logarithms, per_word its mean. Null and empty texts have no words, log_score 0 and no mean. Copies count as other
    documents. Repeated rows come back as often as they are there; an empty table gives no rows.
    """
    chunks = chunked(docs, id_column, text_column)
    total = chunks.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(MOST_PARTS, total // PART_ENTRIES))
    bits = (parts - 1).bit_length()
    # Dealt by the pair of size and part; many more partitions than tasks, so that tasks even out.
    asked = requests(chunks, order, bits)
    kind = chunks.schema["ids"].dataType.elementType
    answers = asked.groupBy("size", "part").applyInArrow(answer, "chunk long, size int, part long, totals binary")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        hashes, rows = _chunk(row["words"], row["codes"], row["lengths"])
        came: dict[int, list] = {size: [] for size in range(1, order + 1)}
        for size, part, totals in zip(*(right.column(c).to_pylist() for c in ("size", "part", "totals"))):
            came[size].append((part, totals))
        tables = [np.concatenate([np.empty(0, np.int64), *(unpacked(t, 8).astype(np.int64) for _, t in sorted(own))]) for _, own in sorted(came.items())]
        logs, backed = document_scores(hashes, rows, tables, total)
        lengths = np.diff(rows)
        mean = [float(x / n) if n else None for x, n in zip(logs, lengths)]
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(lengths), pa.array(logs), pa.array(mean, pa.float64()), pa.array(backed)], names=["id", "n_words", "log_score", "per_word", "n_backoffs"])

    schema = StructType([StructField("id", kind), *_fields("n_words long, log_score double, per_word double, n_backoffs long")])
    whole = chunks.select("chunk", "ids", "lengths", "words", "codes")
    scored = whole.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sums, schema)
    return scored.withColumnRenamed("id", id_column)
