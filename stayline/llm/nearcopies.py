"""Near copies for the pipeline: op1's links, and documents whose five-word shingle sets are alike by SIMILARITY or more.

Candidates come from MinHash: `BANDS` keys of `ROWS` minima each, so two sets at the least similarity share none of them with
probability (1 - 0.8^4)^32, about 5 in 100 million. Equal sets are one. Sixteen bits of each of the 128 minima travel along as
a sketch: two sets at the least similarity agree in fewer than `LIKELY` of them with a probability of 3 in 100,000, and
only pairs that agree so often are verified on their shingle sets (64-bit hashes).

What a group asks for is its connection, not its pairs. First each set meets one member of each of its keys, and the likeliest
of a few of those pairs is verified. Keys whose members are in one class by then, as groups of copies mostly are, are done.
In the others the sketches of different classes are compared inside tasks, in blocks of at most `BLOCK` sets a side, so a
crowded key spreads over tasks; a pair counts in the first of the keys that it shares only, and what leaves a task is each set that
has such a pair. The shingle sets of those then meet in the same blocks, all of a block are compared there, and a
block gives the links that connect its classes, fewer than it has classes, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField

from stayline.llm.common import arrow_map, fresh, map_batches, numbered, release_memory, row_bytes
from stayline.llm.components import components
from stayline.llm.simhash import classes, fingerprint
from stayline.operators.joins import sized_join
from stayline.session import work_path, work_scope
from stayline.sources.tables import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
#: Minima of 128 that a likely pair agrees in.
LIKELY = 84
#: Sets of a block, and shingles of them: a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Centres that a set is measured against before classes are compared.
STARS = 4
#: Shingles whose minima are taken, or that are counted, at a time.
CHUNK = 1 << 13
#: The last bits of keys and parts are the number of their band.
_BAND_BITS = BANDS - 1

_SEEDS = np.random.default_rng(42)
_FLIPS = _SEEDS.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
_FACTORS = _SEEDS.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; a shorter text is one run, a text without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    sums = np.full(count, size, np.uint64)
    for k in range(size):
        sums = _mixed(sums) + hashes[k : k + count]
    return np.unique(_mixed(sums))


def sketch(hashes: np.ndarray) -> bytes:
    """Sixteen bits of the minimum of each order, BANDS runs of ROWS; no shingles give none."""
    if not len(hashes):
        return b""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for low in range(0, len(hashes), CHUNK):
        orders = (hashes[None, low : low + CHUNK] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, orders.min(axis=1))
    return _mixed(least).astype(np.uint16).tobytes()


def enough(shared: int, left: int, right: int) -> bool:
    """Whether sets of these sizes that share so many are alike by SIMILARITY."""
    return shared >= SIMILARITY * (left + right - shared) - 1e-9


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(row_bytes(column)), np.uint16).reshape(len(column), BANDS * ROWS)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, set), each once, sorted by key -> (key, centre, set): every further set of a key with its first."""
    open_key = centre = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sets = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        centres = sets[begin].copy()
        if open_key is not None and keys[0] == open_key:
            centres[0] = centre
        open_key, centre = keys[-1], centres[-1]
        of = np.repeat(centres, np.diff(np.append(begin, len(keys))))
        other = of != sets
        yield pa.RecordBatch.from_arrays([pa.array(v[other]) for v in (keys, of, sets)], ["key", "centre", "set"])


def likeliest(found: list[np.ndarray]) -> list[np.ndarray]:
    """Columns a, b, p, q, agree, n of pairs -> one row per (p, q): the greatest (agree, a, b), and the sum of n."""
    a, b, p, q, agree, n = found
    order = np.lexsort((b, a, agree, q, p))
    p, q = p[order], q[order]
    last = np.append((p[1:] != p[:-1]) | (q[1:] != q[:-1]), True)
    upto = np.cumsum(n[order])[last]
    return [a[order][last], b[order][last], p[last], q[last], agree[order][last], np.diff(upto, prepend=0)]


def _likely_pairs(owner: np.ndarray, marks: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, agree) of the rows x, y of smaller and larger class whose sketches agree in `least` minima, some at a time."""
    for low in range(0, len(owner), 16):
        agree = (marks[low : low + 16, None, :] == marks[None, :, :]).sum(axis=2)
        x, y = np.nonzero((agree >= least) & (owner[low : low + 16, None] < owner[None, :]))
        if len(x):
            yield low + x, y, agree[x, y]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, the part -> each part whole. Holds one batch and the rows of an open part, at most two blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0).to_numpy()
        begins = np.flatnonzero(np.concatenate([[not held or held[-1].column(0)[-1].as_py() != parts[0]], parts[1:] != parts[:-1]])).tolist()
        if held and begins:
            held.append(batch.slice(0, begins[0]))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for low, high in zip(begins, begins[1:]):
            yield pa.Table.from_batches([batch.slice(low, high - low)])
        held.append(batch.slice(begins[-1]) if begins else batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cross(least: int, every: bool):
    """For `arrow_map`: rows (part, set, class, sketch), sorted by part -> (a, b, p, q, agree, n), pairs of unlike classes p < q that agree in `least` minima.

    Of two classes in a part only the likeliest pair is given, with the number n of their pairs there; all pairs, with n = 1, if `every`.
    For the pairs themselves, which may be as many as a part's sets squared; `one_of_each` uses `hopeful` and `spanning`.
    """
    names = ["a", "b", "p", "q", "agree", "n"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_part(batches):
            sets, owner = (part.column(i).to_numpy() for i in (1, 2))
            best: list[np.ndarray] | None = None
            for x, y, agree in _likely_pairs(owner, _sketches(part.column(3).combine_chunks()), least):
                found = [sets[x], sets[y], owner[x], owner[y], agree, np.ones(len(x), np.int64)]
                if every:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)
                else:
                    best = likeliest(found if best is None else [np.concatenate(c) for c in zip(best, found)])
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best], names)

    return compare


def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, set, class, sketch), sorted by part -> (part, set, class) of the sets with a likely pair of another class there.

    A pair that shares several keys counts in the part of the first band of them only, so it is met once however alike it is.
    """
    for part in _by_part(batches):
        marks, owner = _sketches(part.column(3).combine_chunks()), part.column(2).to_numpy()
        band = part.column(0)[0].as_py() & _BAND_BITS
        hope = np.zeros(len(owner), bool)
        for x, y, _ in _likely_pairs(owner, marks, LIKELY):
            shared = (marks[x] == marks[y]).reshape(-1, BANDS, ROWS).all(axis=2)
            first = shared.argmax(axis=1) == band
            hope[x[first]] = hope[y[first]] = True
        if hope.any():
            yield from part.select(["part", "set", "class"]).filter(pa.array(hope)).to_batches()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values every two of these sets of distinct values have in common; on the diagonal, how many a set shares with any other."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])[: len(flat)]
    often = np.bincount(np.cumsum(new) - 1) if len(flat) else np.empty(0, np.int64)
    # A value of one set is in no intersection.
    order = order[np.repeat(often > 1, often)]
    often = often[often > 1]
    value, row = np.repeat(np.arange(len(often)), often), row[order]
    ends = np.append(0, np.cumsum(often))
    shared = np.zeros((len(sets), len(sets)))
    for low in range(0, len(often), CHUNK):
        high = min(low + CHUNK, len(often))
        inside = slice(ends[low], ends[high])
        holds = np.zeros((len(sets), high - low), np.float32)
        holds[row[inside], value[inside] - low] = 1
        shared += holds @ holds.T
    return shared


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, set, class, hashes), sorted by part -> (a, b): classes with alike sets, as few links as connect a part's classes."""
    for part in _by_part(batches):
        sets = [np.frombuffer(h, np.uint64) for h in row_bytes(part.column(3).combine_chunks())]
        classes_, owner = np.unique(part.column(2).to_numpy(), return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        shared = shared_counts(sets)
        alike = shared >= SIMILARITY * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        x, y = np.nonzero(alike & (owner[:, None] < owner[None, :]))
        links, tree = [], list(range(len(classes_)))
        for pair in np.unique(owner[x] * len(classes_) + owner[y]).tolist():
            ends = []
            for node in divmod(pair, len(classes_)):
                while tree[node] != node:
                    tree[node] = node = tree[tree[node]]
                ends.append(node)
            if ends[0] != ends[1]:
                tree[max(ends)] = min(ends)
                links.append(divmod(pair, len(classes_)))
        if links:
            named = classes_[np.array(links)]
            yield pa.RecordBatch.from_arrays([pa.array(named[:, i], pa.int64()) for i in (0, 1)], ["a", "b"])


def likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b, agree) of the pairs (a, b) whose sketches agree often enough; `marks` has (set, sketch)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (_sketches(batch.column(2)) == _sketches(batch.column(3))).sum(axis=1).astype(np.int32)
                found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree)], ["a", "b", "agree"])
                yield found.filter(pa.array(agree >= LIKELY))

    left, right = (marks.select(F.col("set").alias(s), F.col("sketch").alias(n)) for s, n in (("a", "x"), ("b", "y")))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return arrow_map(joined, compare, "a long, b long, agree int")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike; `sets` has (set, hashes). Both are read from files."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good[i] = enough(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    left = sets.select(F.col("set").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("hashes").alias("y"))
    return arrow_map(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), compare, "a long, b long")


def hash_sets(texts: DataFrame) -> DataFrame:
    """(set, hashes) from (set, text); the hashes as bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t).tobytes() for t in row_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], ["set", "hashes"])

    return arrow_map(texts, scan, "set long, hashes binary")


def with_classes(per_set: DataFrame, links: DataFrame) -> DataFrame:
    """(set, class): `per_set` has (set, root) with one root a set, `links` (a, b) pairs of roots.

    Sets of one class are connected. The converse need not hold: a root takes the least of its neighbours, then that one's, and
    that one's again, which brings together what has a centre in common; whole components are found once, at the end.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("root"), F.col("b").alias("to")), F.struct(F.col("b").alias("root"), F.col("a").alias("to"))))
    least = links.select(ends.alias("e")).groupBy("e.root").agg(F.least(F.min("e.to"), F.col("root")).alias("class"))
    for _ in range(2):
        least = materialize(least)
        next_ = least.select(F.col("root").alias("class"), F.col("class").alias("further"))
        least = least.join(next_, "class", "left").select("root", F.coalesce("further", "class").alias("class"))
    both = per_set.select("set", "root").join(least, "root", "left")
    return materialize(both.select("set", F.coalesce("class", "root").alias("class")))


def apart(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose sets are in two classes; `owners` has (set, class)."""
    left, right = (owners.select(F.col("set").alias(s), F.col("class").alias(n)) for s, n in (("a", "_p"), ("b", "_q")))
    return pairs.join(left, "a").join(right, "b").filter("_p <> _q").drop("_p", "_q")


def with_band(hashed: Column, band: Column) -> Column:
    """A hash whose last bits are the band's number."""
    return hashed.bitwiseAND(F.lit(~_BAND_BITS)).bitwiseOR(band.cast("long"))


def blocks(members: DataFrame) -> DataFrame:
    """(part, set, class) from (key, set, class, size): a key of up to BLOCK sets is one part, a larger one a part for each pair of its blocks.

    Sets with many shingles are dealt to more blocks, of BLOCK_SHINGLES on average. A part has its key's band.
    """
    rows, shingled = F.count(F.lit(1)), F.sum(F.col("size").cast("long"))
    needed = F.greatest(F.ceil(rows / BLOCK), F.least(rows, F.ceil(shingled / BLOCK_SHINGLES)))
    sizes = members.groupBy("key").agg(needed.cast("int").alias("n"), F.min("class").alias("least"), F.max("class").alias("most"))
    split = materialize(sizes.filter("least <> most").select("key", "n"))
    own = F.pmod(F.xxhash64("key", "set"), F.col("n")).cast("int")
    dealt = members.join(split, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = with_band(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")), F.col("key").bitwiseAND(F.lit(_BAND_BITS)))
    return dealt.select(part.alias("part"), "set", "class").distinct()


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` without near copies: of every class the row of its smallest id stays, one if that id repeats.

    A class is what can be reached over links of op1 (fingerprints within three bits) and over pairs of five-word shingle sets
    with a Jaccard similarity of SIMILARITY or more. Null ids come last, so a class of such rows alone still keeps one; texts
    without words are one class. Columns and their order are those of `docs`; an empty table gives no rows. What is stored by
    the way is removed before the rows are returned.
    """
    spark = docs.sparkSession
    row, fp, own, size, mark = (fresh(docs, n) for n in ("row", "fp", "shingle_set", "set_size", "sketch"))
    text_at = docs.columns.index(text_column)
    added = [StructField(fp, LongType()), StructField(own, LongType()), StructField(size, IntegerType()), StructField(mark, BinaryType())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, names, sizes, marks = [], [], [], []
            for text in row_bytes(batch.column(text_at)):
                hashes = shingles(text)
                prints.append(fingerprint(text))
                names.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                marks.append(sketch(hashes))
            arrays = [np.array(prints, np.uint64).view(np.int64), np.array(names, np.uint64).view(np.int64), np.array(sizes, np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(a) for a in arrays), pa.array(marks, pa.binary())], [*batch.schema.names, fp, own, size, mark]
            )
        release_memory()

    whole = numbered(map_batches(docs, scan, [*docs.schema.fields, *added]), row)
    names = {row: "row", id_column: "id", text_column: "text", fp: "fp", own: "set", size: "size", mark: "sketch"}
    target = work_path(spark, "table")
    with work_scope(spark):
        chosen = materialize(_first_rows(whole.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])), target)
    return sized_join(whole, chosen.toDF(row), [row], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _first_rows(whole: DataFrame) -> DataFrame:
    """(row) that stays of each class; `whole` has (row, id, text, fp, set, size, sketch)."""
    rows = whole.select("row", "id", "fp", "set", "size")
    order = F.struct(F.col("id").isNull(), "id", "row")
    firsts = rows.groupBy("fp").agg(F.min(order).alias("first"))
    joined = materialize(firsts.join(classes(rows), "fp"))

    # Equal sets are one; the fingerprints of its rows, which may differ where runs repeat, are linked through it.
    sets = materialize(rows.groupBy("set", "fp").agg(F.min("row").alias("row"), F.first("size").alias("size")))
    rooted = materialize(sets.join(joined.select("fp", "root"), "fp"))
    per_set = materialize(rooted.groupBy("set").agg(F.min("root").alias("root"), F.min("row").alias("row"), F.first("size").alias("size")))
    least = per_set.select("set", F.col("root").alias("least"))
    links = materialize(rooted.join(least, "set").filter("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
    marks = materialize(whole.select("row", "sketch").join(per_set.filter("size > 0"), "row").select("set", "size", "sketch"))

    def hashed(needed: DataFrame) -> DataFrame:
        """(set, hashes), stored, of the distinct sets in `needed`."""
        rows = materialize(per_set.join(needed, "set", "left_semi").select("row", "set"))
        return materialize(hash_sets(sized_join(whole.select("row", "text"), rows, ["row"]).select("set", "text")))

    def found(pairs: DataFrame) -> DataFrame:
        """Links of roots out of the pairs (a, b) that are alike."""
        left, right = (marks.select(F.col("set").alias(s), F.col("size").alias(n)) for s, n in (("a", "n"), ("b", "m")))
        fits = F.least("n", "m") >= F.lit(SIMILARITY) * F.greatest("n", "m") - 1e-9
        open_ = materialize(pairs.select("a", "b").distinct().join(left, "a").join(right, "b").filter(fits).select("a", "b"))
        good = materialize(verified(open_, hashed(open_.select(F.explode(F.array("a", "b")).alias("set")).distinct())))
        left, right = (per_set.select(F.col("set").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
        return good.join(left, "a").join(right, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))

    width = ROWS * 2
    bands = marks.select("set", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    key = with_band(F.xxhash64("band", F.col("sketch").substr(F.col("band") * width + 1, F.lit(width))), F.col("band"))
    # The first set of a key differs from band to band, as its order does.
    dealt = bands.select(key.alias("key"), "set").repartition("key").sortWithinPartitions("key", F.col("key").bitwiseXOR(F.col("set")))
    met = materialize(arrow_map(dealt, meet, "key long, centre long, set long"))

    # Each set with the likeliest of the centres that it met; of at most BANDS those with the least hash, which copies have in common.
    ranked = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("centre").alias("hash"), "centre"))), 1, STARS)
    stars = met.groupBy("set").agg(ranked.alias("stars")).select(F.col("set").alias("a"), F.explode("stars.centre").alias("b"))
    near = likely(apart(stars, per_set.select("set", F.col("root").alias("class"))), marks)
    best = near.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = materialize(links.unionByName(found(materialize(best))))

    # Keys that hold several classes still: sets with a likely pair there, and links between the classes of those that are alike.
    members = met.select("key", "set").unionByName(met.select("key", F.col("centre").alias("set")).distinct())
    owners = with_classes(per_set, links).join(per_set.select("set", "size"), "set")
    parts = materialize(blocks(materialize(members.join(owners, "set"))))
    sketched = parts.join(marks.select("set", "sketch"), "set").select("part", "set", "class", "sketch")
    hoped = materialize(arrow_map(sketched.repartition("part").sortWithinPartitions("part"), hopeful, "part long, set long, class long"))
    filled = hoped.join(hashed(hoped.select("set").distinct()), "set").select("part", "set", "class", "hashes")
    more = materialize(arrow_map(filled.repartition("part").sortWithinPartitions("part"), spanning, "a long, b long"))
    whole_classes = components(links.unionByName(more)).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    named = joined.join(whole_classes, "root", "left").select(F.coalesce("joined", "root").alias("root"), "first")
    return named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
