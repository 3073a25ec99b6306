"""Periodic runs of words, by uniting suffix classes in order of decreasing common prefix.

The suffixes of a text are sorted (prefix doubling over word numbers) and joined, neighbour by neighbour, from the longest
common prefix down. Each class keeps its positions in order. When a union at prefix length l makes positions i < j
neighbours, the words at i and at j agree for exactly l words; if j - i <= l these two copies touch, and i starts a stretch of
period j - i. A start that the word before would extend is not a run's first word and is passed over, so every run is
found once. That the period is the smallest follows from the neighbourhood: a shorter period would put a position between.

A run of at least `MIN_LENGTH` words repeats its first `GRAM` words, so only suffixes that share so many are united, and
a text without such a repetition is done after one sort.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stayline.llm.common import arrow_map, fresh, map_batches, row_bytes

MIN_LENGTH = 12
#: A run has a length of 12 and of two periods, so it agrees with itself, one period on, for at least six words.
GRAM = MIN_LENGTH // 2
RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))

_FACTORS = np.random.default_rng(12).integers(0, 1 << 63, GRAM, np.uint64) * np.uint64(2) + np.uint64(1)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def repeats(ids: np.ndarray) -> bool:
    """Whether some GRAM words in a row occur twice; now and then true without that (equal hashes), never false with it."""
    count = len(ids) - GRAM + 1
    if count < 2:
        return False
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(count, np.uint64)
    for k in range(GRAM):
        sums += mixed[k : k + count] * _FACTORS[k]
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, words that each shares with the one before), by prefix doubling; the first shares none."""
    n = len(ids)
    rank, size, levels = ids.astype(np.int64) + 1, 1, []
    while True:
        levels.append((size, rank))
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:]
        key = rank * np.int64(n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, size = new, 2 * size
        if new[order[-1]] == n or size >= n:
            break
    shared = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    for size, rank in reversed(levels):
        x, y = left + shared[1:], right + shared[1:]
        inside = np.maximum(x, y) + size <= n
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        shared[1:] += np.where(same, size, 0)
    return order, shared


def word_runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers (0 to n - 1), by start, then period."""
    if not repeats(ids):
        return []
    order, shared = sorted_suffixes(ids)
    joins = np.flatnonzero(shared >= GRAM)
    joins = joins[np.argsort(-shared[joins], kind="stable")]
    words, n = ids.tolist(), len(ids)
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    runs: list[Run] = []
    level, seeds = -1, {}

    def close() -> None:
        for i, period in seeds.items():
            if level + period >= MIN_LENGTH and (i == 0 or words[i - 1] != words[i + period - 1]):
                runs.append(Run(i, level + period, period))

    def meet(i: int, j: int) -> None:
        # Another union at the same length may still put a position between: the nearest one counts.
        if j - i <= level and j - i < seeds.get(i, n):
            seeds[i] = j - i

    for at, prefix in zip(joins.tolist(), shared[joins].tolist()):
        if prefix != level:
            close()
            level, seeds = prefix, {}
        a, b = find(int(order[at - 1])), find(int(order[at]))
        big, small = members.pop(a, [a]), members.pop(b, [b])
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        parent[b] = a
        for k, i in enumerate(small):
            place = bisect_left(big, i)
            # Neighbours on either side in the union: of the other class, unless this class has one nearer.
            if place and (k == 0 or small[k - 1] < big[place - 1]):
                meet(big[place - 1], i)
            if place < len(big) and (k + 1 == len(small) or small[k + 1] > big[place]):
                meet(i, big[place])
        if len(small) * 8 < len(big):
            for i in small:
                big.insert(bisect_left(big, i), i)
        else:
            big = sorted(big + small)
        members[a] = big
    close()
    return sorted(runs, key=lambda r: (r.start, r.period))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """True for the words that stay if every run is cut down to its first period; a word goes if any run drops it."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, text_column: str = "text", names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """The rows of `docs` with `runs` (start, length, period; by start, then period) and `collapsed`, the text without repetitions.

    Words are what ASCII blanks leave apart. A run is a stretch with a smallest period of q words, at least MIN_LENGTH and 2q
    long, that neither neighbour extends. `collapsed` joins by one space the words that no run holds after its first q.
    Null and blank texts have no runs and collapse to the empty text. Every row stays, repeated ones too; a column
    that has one of the new names gives way to a new name with an underscore in front. An empty table gives no rows.
    """
    at = docs.columns.index(text_column)
    added = [fresh(docs, n) for n in names]
    fields = [*docs.schema.fields, StructField(added[0], RUNS), StructField(added[1], StringType())]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in Run._fields]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for text in row_bytes(batch.column(at)):
                words = text.split()
                runs = word_runs(_numbers(words))
                if runs:
                    stay = kept_words(len(words), runs)
                    words = [w for w, good in zip(words, stay.tolist()) if good]
                found.append([r._asdict() for r in runs])
                left.append(b" ".join(words))
            text = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), text], [*batch.schema.names, *added])

    return map_batches(docs, scan, fields)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words): the documents with the repetitions that the query op12 plants, words joined by one space.

    Whether and where is drawn from the id; nothing is planted where that is null.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), row_bytes(batch.column(1))):
                words = text.split()
                n = len(words)
                if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
                    g = h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    block = words[a : a + p]
                    words = words[:a] + (block * -(-(n - a) // len(block)))[: n - a]
                texts.append(b" ".join(words))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "text", "n_words"]
            )

    kept = docs.select("doc_id", "text")
    return arrow_map(kept, scan, f"doc_id {dict(kept.dtypes)['doc_id']}, text string, n_words long")


def digest(found: DataFrame) -> DataFrame:
    """One row a document out of `periodic_runs`: number of runs, the longest (ties: smallest start, then period), digests."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"], r["period"])))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.shorter") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
