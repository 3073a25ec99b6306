"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

A word is a run of letters and digits, or a run of other printable characters ("!!", "***"). Three families of features
are hashed into one table of weights: words in lower case, pairs of neighbouring words, and pairs of word shapes (case,
digits, symbols, and whether a word repeats the one before). A feature's value is its share of the family in the text, so
a score is one sparse dot product and does not grow with the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from stayline.llm.common import arrow_map, fresh, held_out, map_batches, release_memory, text_buffer, uniform
from stayline.llm.tokens import ascii_fold, byte_class, hash_words, joined, mixed

#: Weights; a power of two.
SIZE = 1 << 18
#: Labelled rows that a fit reads at most, chosen by a seeded hash of the id; above 20,000 held-out accuracy stands still.
SAMPLE = 20_000
SHARDS = 8
#: Rows whose features are held at a time.
PIECE = 200
EPOCHS = 4
KEEP_AT = 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-5
SCALE = 16.0


def _classes() -> np.ndarray:
    """0 for blanks and controls, 1 for letters, digits and all bytes above ASCII, 2 for other characters."""
    classes = byte_class(bytes(range(33)) + b"\x7f")
    symbols = [c for c in range(33, 127) if not chr(c).isalnum()]
    classes[symbols] = 2
    return classes


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first entry of each row and the end), the entries of a row side by side; repeats stay apart."""
    classes = _classes()
    words, first, kinds, rows = hash_words(data, at, classes, ascii_fold())
    n = len(words)
    lengths = np.diff(rows)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    # The shape of a word: its first byte, whether its last byte is a capital too, symbols as they are, repeats.
    begins = data[first] if n else np.empty(0, np.uint8)
    ends = np.append(first[1:], len(data)) if n else first
    second = data[np.minimum(first + 1, np.maximum(ends - 1, first))] if n else begins
    shape = np.full(n, 7, np.uint64)
    for code, (low, high) in enumerate(((65, 90), (97, 122), (48, 57), (128, 255)), start=1):
        shape[(begins >= low) & (begins <= high)] = code
    shape += np.uint64(16) * ((second >= 65) & (second <= 90)).astype(np.uint64)
    symbol = kinds == 2
    shape[symbol] = words[symbol]
    again = np.zeros(n, bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    shape[again] = 99
    shape = mixed(shape)
    before = np.zeros(n, np.uint64)
    before[1:] = words[:-1]
    shape_before = np.zeros(n, np.uint64)
    shape_before[1:] = shape[:-1]
    starts = rows[:-1][lengths > 0]
    before[starts] = 1
    shape_before[starts] = 1
    families = np.stack([mixed(words + np.uint64(11)), joined(before, words) + np.uint64(12), joined(shape_before, shape) + np.uint64(13)], axis=1)
    index = (families & np.uint64(SIZE - 1)).astype(np.int64).ravel()
    share = np.repeat(SCALE / np.maximum(lengths, 1), 3 * lengths)
    return index, share, 3 * rows


def margins(weights: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The dot product of every row; a row without words has the bias alone. weights: SIZE of them, then the bias."""
    index, value, rows = features(data, at)
    sums = np.concatenate([[0.0], np.cumsum(weights[index] * value)])
    return weights[SIZE] + sums[rows[1:]] - sums[rows[:-1]]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, float, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Follow-the-regularised-leader with per-coordinate rates over rows in their order.

    A row is (index, count of each, what one counts for, label); the bias has an index and no count.
    """
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(i):
        active = np.abs(z[i]) > L1
        return np.where(active, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for index, counts, scale, label in rows:
            value = np.append(counts * scale, 1.0)
            w = weights(index)
            g = (sigmoid(float(w @ value)) - label) * value
            grown = n[index] + g * g
            z[index] += g - (np.sqrt(grown) - np.sqrt(n[index])) / ALPHA * w
            n[index] = grown
    return weights(np.arange(SIZE + 1))


def _rows(texts: pa.Array, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    out = []
    index, value, rows = features(*text_buffer(texts))
    for i, label in enumerate(labels):
        own, counts = np.unique(index[rows[i] : rows[i + 1]], return_counts=True)
        scale = float(value[rows[i]]) if rows[i] < rows[i + 1] else 0.0
        out.append((np.append(own, SIZE).astype(np.int32), counts.astype(np.int32), scale, int(label)))
    return out


def learnable(labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, label), one row an id, of at most about `sample` ids that are not held out.

    The sample is a fixed fraction by a seeded hash of the id, whatever the order of rows. An id with repeated labels takes
    their majority; ids with a draw, null ids and null labels say nothing.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    total = known.count()
    drawn = known.filter(uniform("id", seed=9) * total < sample)
    means = drawn.groupBy("id").agg(F.avg("label").alias("mean")).filter("mean <> 0.5")
    return means.select("id", (F.col("mean") > 0.5).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights and bias. Without labelled rows all are zero, and every score is one half.

    Each of SHARDS parts of the sample is fitted by its own task, in the order of a hash; the models are averaged by their
    number of rows. The sample has at most about `sample` ids, which may be broadcast, and one document of each (the first by that
    hash, null texts aside).
    """
    drawn = learnable(labels, id_column, label_column, sample)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.col("text").isNotNull())
    texts = texts.join(F.broadcast(drawn), "id").select("id", "label", uniform("id", "text", seed=10).alias("order"), "text")
    # One row an id, however often it is there: the sample bounds rows as well.
    texts = texts.groupBy("id").agg(F.min(F.struct("order", "text", "label")).alias("first")).select("first.*")
    dealt = texts.withColumn("shard", F.floor(F.col("order") * SHARDS)).repartition(SHARDS, "shard").sortWithinPartitions("shard", "order", "text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for low in range(0, batch.num_rows, PIECE):
                rows += _rows(batch.column(0).slice(low, PIECE), labels[low : low + PIECE])
        release_memory()
        if rows:
            model = fit_rows(rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([model.tobytes()])], ["n", "model"])

    total, weights = 0, np.zeros(SIZE + 1)
    models = arrow_map(dealt.select("text", "label"), part, "n long, model binary").collect()
    for row in sorted(models, key=lambda r: bytes(r["model"])):
        weights += row["n"] * np.frombuffer(row["model"], np.float64)
        total += row["n"]
    return weights / max(total, 1)


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text", out: str = "score") -> DataFrame:
    """The rows with `out`, the probability of label 1; null is scored like the empty text, by the bias.

    `out` takes the place of a column of that name.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    plain = docs.drop(out)
    at = plain.columns.index(text_column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PIECE):
                piece = batch.slice(low, PIECE)
                p = sigmoid(margins(model.value, *text_buffer(piece.column(at))))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p)], [*piece.schema.names, out])
        release_memory()

    return map_batches(plain, scan, [*plain.schema.fields, StructField(out, DoubleType())])


def predictions(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **columns: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null or empty text has the bias as its score."""
    weights = fit(docs, labels, **columns)
    slim = docs.select("doc_id", "text")
    scored = score(slim, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of `docs` that score `keep_at` or more, with the columns of `docs`."""
    out = fresh(docs, "score")
    return score(docs, fit(docs, labels), out=out).filter(F.col(out) >= keep_at).drop(out)
