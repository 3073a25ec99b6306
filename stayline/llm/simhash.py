"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in three bits meet half-way: leave out one block of bits that holds one of them, and the two
left are one flip from either side. So every distinct fingerprint emits, for each of four blocks, itself without the
block and all its single flips outside it (196 rows instead of the 2,081 of a whole ball of radius two); rows are shuffled
by variant, and fingerprints that collide are verified by their Hamming distance.

A variant that more than `CROWD` fingerprints share is not compared pair by pair. Its fingerprints go on to the whole ball
of radius two around each, where a fingerprint at most one flip from a variant is within three bits of all that share it:
one link from it to each of them, no pairs. Both ways keep every connection, and every class stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import arrow_map, row_bytes
from stayline.llm.components import components
from stayline.sources.tables import materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
BLOCKS = 4
CROWD = 256
CHUNK = 1 << 16
#: Fingerprints of which one task makes the variants.
EMIT_ROWS = 20_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of UTF-8 bytes: a bit is set if over half the shingle hashes have it; no words give 0."""
    words = text.lower().split()
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for low in range(0, total, CHUNK):
        part = words[low : low + CHUNK + shingle - 1]
        count = min(CHUNK, total - low)
        runs = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(digest, runs), np.uint64, count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint) of every row, null text as the empty one; the fingerprint is a signed 64-bit number."""
    kept = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in row_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return arrow_map(kept, scan, f"id {dict(kept.dtypes)['id']}, fp long")


def half_balls(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, fingerprint) rows: per block, the fingerprint without it and its flips elsewhere.

    The emptied block carries the block's number, so variants of different blocks rarely meet (and are verified if so).
    """
    width = BITS // BLOCKS
    keys = []
    for block in range(BLOCKS):
        hole = np.uint64(((1 << width) - 1) << (block * width))
        rest = prints & ~hole | np.uint64(block << (block * width))
        keys.append(rest)
        keys += [rest ^ np.uint64(1 << bit) for bit in range(BITS) if bit // width != block]
    return np.concatenate(keys), np.tile(prints, len(keys))


def whole_balls(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, flips, fingerprint) rows of the ball of radius two."""
    ones = [np.uint64(1 << i) for i in range(BITS)]
    masks = [np.uint64(0), *ones, *(a ^ b for i, a in enumerate(ones) for b in ones[:i])]
    flips = np.array([0] + [1] * BITS + [2] * (len(masks) - BITS - 1), np.int8)
    keys = (np.array(masks)[:, None] ^ prints[None, :]).ravel()
    return keys, np.repeat(flips, len(prints)), np.tile(prints, len(masks))


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what can be reached over pairs within the radius, one fewer than its members each."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
    left = np.ones(len(prints), bool)
    links = []
    for root in range(len(prints)):
        if not left[root]:
            continue
        left[root] = False
        open_ = [root]
        while open_:
            at = open_.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            links += [(at, int(i)) for i in found]
            open_ += found.tolist()
    return links


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([left, right], axis=1), axis=0) if len(left) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy(), pa.int64()), pa.array(both[:, 1].copy(), pa.int64())], ["a", "b"])


def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, fingerprint) sorted by variant -> verified links (a, b); a = b marks a member of a crowded variant.

    Holds one batch and at most CROWD rows of an open variant.
    """
    open_key, held, crowded = None, np.empty(0, np.uint64), False
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        left, right = [], []
        if open_key is not None and crowded:
            same = int(np.searchsorted(keys, open_key, side="right"))
            left.append(prints[:same])
            right.append(prints[:same])
            keys, prints = keys[same:], prints[same:]
            if not len(keys):
                yield _pairs(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))
                continue
            crowded = False
        elif open_key is not None:
            keys = np.concatenate([np.full(len(held), open_key), keys])
            prints = np.concatenate([held, prints])
        if not len(keys):
            continue
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        end = np.append(begin[1:], len(keys))
        open_key, held = keys[-1], prints[begin[-1] :]
        if len(held) > CROWD:
            left.append(held)
            right.append(held)
            crowded, held = True, held[:0]
        _solve(prints, begin[:-1], end[:-1], left, right)
        if left:
            yield _pairs(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))
    if open_key is not None and not crowded:
        left, right = [], []
        _solve(held, np.array([0]), np.array([len(held)]), left, right)
        if left:
            yield _pairs(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))


def _solve(prints: np.ndarray, begin: np.ndarray, end: np.ndarray, left: list, right: list) -> None:
    """Appends the links inside the closed runs begin:end."""
    size = end - begin
    two = begin[size == 2]
    x, y = prints[two], prints[two + 1]
    near = (np.bitwise_count(x ^ y) <= RADIUS) & (x != y)
    left.append(x[near])
    right.append(y[near])
    for low, high in zip(begin[size > 2], end[size > 2]):
        members = np.unique(prints[low:high])
        if high - low > CROWD:
            left.append(members)
            right.append(members)
        elif links := forest(members):
            pairs = np.array(links)
            left.append(members[pairs[:, 0]])
            right.append(members[pairs[:, 1]])


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, flips, fingerprint), sorted -> links from a variant's first row to its others, if that is one flip away at most."""
    open_key, centre, sure = None, None, False
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        flips = batch.column(1).to_numpy(zero_copy_only=False)
        prints = batch.column(2).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lengths = np.diff(np.append(begin, len(keys)))
        centres, good = prints[begin].copy(), flips[begin] <= 1
        if open_key is not None and keys[0] == open_key:
            centres[0], good[0] = centre, sure
        open_key, centre, sure = keys[-1], centres[-1], good[-1]
        of, ok = np.repeat(centres, lengths), np.repeat(good, lengths)
        ok &= of != prints
        yield _pairs(of[ok], prints[ok])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within RADIUS bits; `distinct` has one column fp without repeats."""

    def emit(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(prints), 2000):
                keys, of = half_balls(prints[low : low + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(of.view(np.int64))], ["variant", "fp"])

    def emit_whole(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(prints), 100):
                keys, flips, of = whole_balls(prints[low : low + 100])
                arrays = [pa.array(keys.view(np.int64)), pa.array(flips), pa.array(of.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["variant", "flips", "fp"])

    # Each fingerprint makes 196 rows: as many tasks as that needs, however small the table is in bytes.
    tasks = max(1, distinct.count() // EMIT_ROWS)
    variants = arrow_map(distinct.repartition(tasks), emit, "variant long, fp long").repartition("variant")
    found = arrow_map(variants.sortWithinPartitions("variant", "fp"), collide, "a long, b long")
    found = materialize(found.distinct())
    crowd = found.filter("a = b").select(F.col("a").alias("fp"))
    crowd = crowd.repartition(max(1, crowd.count() // (EMIT_ROWS // 10)))
    balls = arrow_map(crowd, emit_whole, "variant long, flips byte, fp long").repartition("variant")
    spread = arrow_map(balls.sortWithinPartitions("variant", "flips", "fp"), stars, "a long, b long")
    return found.filter("a <> b").unionByName(spread)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint of `prints` (columns id, fp): equal roots can be reached from each other."""
    distinct = materialize(prints.select("fp").distinct())
    rooted = materialize(components(links(distinct)))
    joined = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left")
    return materialize(joined.withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row.

    Rows of equal fingerprint, and fingerprints that differ in three bits or fewer, are linked; component_id is the smallest
    id that can be reached, itself included. Texts without words (null too) have fingerprint zero and are linked like any
    other. Rows whose id is null take part but name no component: a component of such rows alone has a null name. Repeated
    rows come back as often as they are there; an empty table gives no rows; other columns are not looked at.
    """
    prints = materialize(fingerprints(docs, id_column, text_column, shingle))
    roots = classes(prints)
    smallest = materialize(prints.groupBy("fp").agg(F.min("id").alias("least_id")))
    joined = materialize(smallest.join(roots, "fp"))
    names = materialize(joined.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = materialize(joined.join(names, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
