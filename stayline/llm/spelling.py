"""Spelling variants: words of a corpus within one inserted, deleted or replaced letter of each other.

The vocabulary is cut into sorted lists. If the longer of two near words has M letters, they agree on the first M // 2 or
on the last M - M // 2; so each word goes, for M its own length and one more, into the list of its first letters and the
list of its last ones, and only the rest of it is compared. A list is scanned as a tree: neighbours that share d letters
share the rows of the edit matrix down to row d, so each distinct beginning gets one row a query, of the two diagonals that
one edit can reach, and once both exceed one edit all words with that beginning are skipped. All queries of many
lists go down together, one letter at a time, in NumPy arrays.

A list of more than `CROWD` words is never scanned whole: its words go on to lists that fix all but `WINDOW` letters, which hold
8,190 words at most. Which lists those are comes as a bit table of fixed size; a list that meets a set bit by chance is cut
finer too, with the same pairs. Every pair is counted in one list only, by where its words first differ.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import arrow_map, row_bytes, text_buffer
from stayline.sources.tables import materialize

#: Letters: A to Z and U+00C0 to U+00FF, so a letter is one byte in Latin-1.
LETTERS = re.compile("[a-zÀ-ÿ]+")
MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
CROWD = 1024
WINDOW = 2
BITS = 23
#: Distinct words that a task counts before it passes them on, and queries that go down a list together.
HELD = 200_000
QUERIES = 1 << 14
FAR = 2


def word_counts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    spelled: Callable[[object, str], str] | None = None,
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of at least `min_letters`, found at least `min_count` times in all texts.

    `spelled(id, word)` may say under which spelling a word of a document counts. Null and blank texts have no words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), row_bytes(batch.column(1))):
                own = Counter(LETTERS.findall(text.lower().decode()))
                for word, n in own.items():
                    if spelled is not None:
                        word = spelled(i, word)
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) > HELD:
                    yield counted()
                    held.clear()
        yield counted()

    kept = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    counts = arrow_map(kept, scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def dropped_letter(doc_id: object, word: str) -> str:
    """The spelling under which the query op13 counts a word of a document: one letter is left out where 31 divides a digest of both.

    A null id leaves nothing out.
    """
    digest = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
    at = digest % len(word)
    return word if digest % 31 else word[:at] + word[at + 1 :]


def _lists(vocabulary: DataFrame) -> DataFrame:
    """(part, rest, next, whole, word, n): each word in its four lists; `next` is the letter after the rest where it must not match.

    `whole` marks the words of the list's greater length. `part` names the list.
    """
    word, size = F.col("word"), F.length("word")
    ways = []
    for more in (0, 1):
        longest = size + more
        head = F.floor(longest / 2).cast("int")
        tail = longest - head
        first, last = F.substring(word, F.lit(1), head), F.substring(word, size - tail + 1, tail)
        name = lambda kind, half: F.concat_ws(" ", longest.cast("string"), F.lit(kind), half)
        ways.append(F.struct(name("f", first).alias("part"), F.substring(word, head + 1, size).alias("rest"), F.lit("").alias("next"), F.lit(more == 0).alias("whole")))
        rest = F.substring(word, F.lit(1), size - tail)
        ways.append(F.struct(name("l", last).alias("part"), rest.alias("rest"), F.substring(last, 1, 1).alias("next"), F.lit(more == 0).alias("whole")))
    return vocabulary.select("word", "n", F.explode(F.array(*ways)).alias("w")).select("w.*", "word", "n")


def _bit(part: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(part), 64 - BITS)


def _crowded(lists: DataFrame) -> list[tuple[int, int]]:
    """The set words of the bit table of crowded lists: at most 2^BITS / 64 rows, whatever the data."""
    crowds = lists.groupBy("part").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD)
    bits = crowds.select(_bit(F.col("part")).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("ones"))
    return [(r["at"], r["ones"]) for r in words.collect()]


def _finer(lists: DataFrame) -> DataFrame:
    """The rows of crowded lists in lists that fix all letters but one window of WINDOW."""
    rest, size = F.col("rest"), F.length("rest")
    longest = F.when(F.col("whole"), size).otherwise(size + 1)
    windows = F.transform(F.sequence(F.lit(0), F.floor((longest - 1) / WINDOW)), lambda i: (i * WINDOW).cast("int"))
    rows = lists.withColumn("low", F.explode(windows)).withColumn("high", F.least(F.col("low") + WINDOW, longest))
    end = F.when(F.col("whole"), F.col("high")).otherwise(F.col("high") - 1)
    after = F.substring(rest, end + 1, size)
    return rows.select(
        F.concat_ws(" ", "part", F.col("low").cast("string"), F.substring(rest, F.lit(1), F.col("low")), after).alias("part"),
        F.substring(rest, F.col("low") + 1, end - F.col("low")).alias("rest"),
        F.when(after != "", F.substring(after, 1, 1)).otherwise(F.col("next")).alias("next"),
        "whole",
        "word",
        "n",
    )


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all rows end to end, one byte each, and where each row begins."""
    data, at = text_buffer(column)
    lead = data == 0xC3
    before = np.concatenate([[0], np.cumsum(lead)])
    return np.where(data >= 0x80, data + np.uint8(0x40), data)[~lead], at - before[at]


def near_pairs(part: np.ndarray, letters: np.ndarray, at: np.ndarray, after: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, target) rows at exactly one edit, in both directions; rows are sorted by part, then rest.

    Queries are the whole rows; a target is whole (a replaced letter) or has one letter fewer.
    """
    n, size = len(part), np.diff(at)
    padded = np.append(letters, np.uint8(0))

    def letter(rows: np.ndarray, depth) -> np.ndarray:
        inside = depth < size[rows]
        return np.where(inside, padded[np.where(inside, at[rows] + depth, 0)], 0)

    together = np.concatenate([[False], part[1:] == part[:-1]])
    starts = np.flatnonzero(~together)
    node_of = np.cumsum(~together) - 1
    query = np.flatnonzero(whole)
    node = node_of[query]
    alone = np.diff(np.append(starts, n))[node] == 1
    query, node = query[~alone], node[~alone]
    x, y = np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
    found_q, found_t = [], []
    depth, rows = 0, np.arange(n)
    while len(query):
        # A beginning that is a word of the list: the first row that has it.
        target = starts[node]
        ends = size[target] == depth
        q, t, same, gone = query[ends], target[ends], x[ends], y[ends]
        left = size[q] - depth
        replaced = whole[t] & (left == 0) & (same == 1)
        deleted = ~whole[t] & (left == 1) & (gone == 1) & ~((same == 0) & (letter(q, depth) == after[q]) & (after[q] > 0))
        found_q += [q[replaced], q[deleted], t[deleted]]
        found_t += [t[replaced], t[deleted], q[deleted]]
        # One letter further: the distinct beginnings, and those that continue each of the present ones.
        current = letter(rows, depth)
        longer = size > depth
        together = together & np.concatenate([[False], current[1:] == current[:-1]]) & longer
        below = np.cumsum(~together) - 1
        first = below[starts]
        count = np.append(first[1:], below[-1] + 1) - first
        starts = np.flatnonzero(~together)
        times = count[node]
        child = np.repeat(first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        query, x, y = np.repeat(query, times), np.repeat(x, times), np.repeat(y, times)
        here = letter(starts[child], depth)
        new = np.minimum(x + ((letter(query, depth) != here) | (here == 0)), FAR).astype(np.int8)
        next_new = np.minimum(np.minimum(y + ((letter(query, depth + 1) != here) | (here == 0)), new + 1), FAR).astype(np.int8)
        good = (here > 0) & ((new <= 1) | (next_new <= 1)) & (size[query] > depth)
        query, node, x, y = query[good], child[good], new[good], next_new[good]
        depth += 1
    return np.concatenate(found_q or [np.empty(0, int)]), np.concatenate(found_t or [np.empty(0, int)])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted list rows -> (word, n_near, minus_n, near): per word of a list its near words, and those with the largest count."""
    held: pa.RecordBatch | None = None

    def solve(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = table.column("part").dictionary_encode()
        part = names.indices.to_numpy()
        lists = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        low = 0
        while low < len(part):
            # Whole lists, about QUERIES rows at a time.
            high = int(lists[np.searchsorted(lists, min(low + QUERIES, len(part)), side="left")])
            yield from best(table.slice(low, high - low), part[low:high])
            low = high

    def best(table: pa.RecordBatch, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        letters, at = _letters(table.column("rest"))
        after, starts = _letters(table.column("next"))
        after = np.where(np.diff(starts) > 0, np.append(after, np.uint8(0))[starts[:-1]], 0)
        whole = table.column("whole").to_numpy(zero_copy_only=False)
        n = table.column("n").to_numpy()
        q, t = near_pairs(part, letters, at, after, whole)
        if not len(q):
            return
        order = np.lexsort((-n[t], q))
        q, t = q[order], t[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        times = np.diff(np.append(begin, len(q)))
        largest = n[t] == np.repeat(n[t[begin]], times)
        count = np.zeros(len(q), np.int64)
        count[begin] = times
        word = table.column("word")
        columns = [word.take(pa.array(q[largest])), pa.array(count[largest]), pa.array(-n[t[largest]]), word.take(pa.array(t[largest]))]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "minus_n", "near"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        # The last list may go on in the next batch.
        last = batch.column("part")[-1]
        part = batch.column("part")
        low, high = 0, batch.num_rows - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if part[middle] == last else (middle + 1, high)
        if low:
            yield from solve(batch.slice(0, low))
        held = batch.slice(low)
    if held is not None:
        yield from solve(held)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n, n_near): `near` is the near word of largest count (ties: the smallest), null if there is none.

    `vocabulary`: distinct words of letters with a count n, read from files. Words come back in no order, each once.
    """
    lists = _lists(vocabulary)
    crowded = _crowded(lists)
    if crowded:
        spark = vocabulary.sparkSession
        table = F.broadcast(spark.createDataFrame(crowded, "at long, ones long"))
        bit = _bit(F.col("part"))
        marked = lists.withColumn("bit", bit).withColumn("at", F.shiftright("bit", 6)).join(table, "at", "left")
        marked = marked.withColumn("crowd", F.coalesce(F.expr("shiftrightunsigned(ones, cast(bit & 63 as int)) & 1"), F.lit(0)) == 1)
        plain = ["part", "rest", "next", "whole", "word", "n"]
        lists = marked.filter("not crowd").select(plain).unionByName(_finer(marked.filter("crowd").select(plain)))
    dealt = lists.repartition("part").sortWithinPartitions("part", "rest")
    found = arrow_map(dealt, _scan, "word string, n_near long, minus_n long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("best"))
    return vocabulary.join(best, "word", "left").select(
        "word", "n", F.col("best.near").alias("near"), (-F.col("best.minus_n")).alias("near_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that are another's form and have one themselves; forms: (word, form)."""
    chain = materialize(forms.join(forms.select(F.col("form").alias("word")).distinct(), "word", "left_semi").select("word", F.col("form").alias("root")))
    # Each round doubles the steps that are followed; a form is RATIO times as frequent as its word, so there are few.
    while True:
        far = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = materialize(chain.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not chain.filter("moved").limit(1).count():
            return chain.select("word", "root")
        chain = chain.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the near word that it is taken to be a variant of.

    `vocabulary` has (word, n), each word once, as `word_counts` gives it. The form is the near word of largest count if that is at
    least `ratio` times the word's; the root is the last form of the chain, the word itself if it has none. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its word: ratio is 2 or more")
    vocabulary = materialize(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(vocabulary)
    taken = F.col("near_n") >= ratio * F.col("n")
    named = materialize(near.select("word", F.when(taken, F.col("near")).alias("form"), "n", "n_near", F.when(taken, F.col("near_n")).alias("form_n")))
    roots = materialize(_roots(named.filter("form is not null").select("word", "form")))
    joined = named.join(roots.select(F.col("word").alias("form"), F.col("root")), "form", "left")
    return joined.select("word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n")
