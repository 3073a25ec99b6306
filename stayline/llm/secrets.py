"""Secret scans: fixed patterns, and strings that two character Markov models hold for random.

The models are tables of character pairs. One is counted over all text outside the patterns' matches (ordinary words and
identifiers), the other over the values that the patterns caught (labelled samples of secrets). A run of 16 or more
characters of an alphabet that keys are written in is a secret if the ratio of its likelihoods is at least a million.
Counting and looking for runs is one pass; the models have a fixed number of cells, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from stayline.llm.common import arrow_map, fresh, map_batches, row_bytes
from stayline.sources.tables import materialize

ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 8
MIN_RUN = 16
#: Log-likelihood ratio from which a run is held for random: one secret in a million runs.
CUT = math.log(1e6)
#: States: 0 the edge of a run, 1 to 94 printable ASCII.
STATES = 95
KEY_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
RUN = StructType([*SPAN.fields[1:], StructField("text", StringType())])


def _state_of() -> np.ndarray:
    """State of each byte; bytes that no key holds, those of other letters and signs among them, end a run."""
    states = np.zeros(256, np.int64)
    for c in KEY_BYTES:
        states[c] = c - 32
    return states


STATE = _state_of()
HEX_MAP = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
RUN_MAP = bytes(99 if STATE[c] else 32 for c in range(256))
RUN_AT_LEAST = re.compile(rb"c{%d,}" % MIN_RUN)


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the value) of the patterns' matches, in bytes, by start and kind."""
    found = []
    low = data.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= MIN_VALUE]
    if b"AKIA" in data:
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(data)]
    if b"h" * 32 in data.translate(HEX_MAP):
        found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(data)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def runs(data: bytes) -> list[tuple[int, int]]:
    """Places of runs of MIN_RUN or more key characters, in bytes."""
    shape = data.translate(RUN_MAP)
    if b"c" * MIN_RUN not in shape:
        return []
    return [m.span() for m in RUN_AT_LEAST.finditer(shape)]


def apart(found: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """What the base spans leave of the runs, in pieces of MIN_RUN or more; both lists ascend by start."""
    if not base:
        return found
    starts = [span[1] for span in base]
    # The farthest end so far: a span that begins inside the piece, or the reach of those before it, cuts it.
    reach = list(accumulate((span[2] for span in base), max))
    pieces = []
    for low, high in found:
        at = bisect_left(starts, low)
        low = max(low, reach[at - 1]) if at else low
        while low < high:
            stop = min(high, starts[at]) if at < len(base) else high
            if stop - low >= MIN_RUN:
                pieces.append((low, stop))
            if stop == high:
                break
            low = max(low, reach[at])
            at += 1
    return pieces


def pair_counts(data: np.ndarray) -> np.ndarray:
    """How often each pair of states stands side by side; a run has an edge at both ends."""
    states = np.concatenate([[0], STATE[data], [0]])
    counts = np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)
    counts[0] = 0
    return counts


def chars(data: bytes, places: list[int]) -> list[int]:
    """Byte offsets as code points."""
    if data.isascii():
        return places
    count = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [int(count[p]) for p in places]


def scanned(docs: DataFrame, keep: list[str], text_column: str) -> tuple[DataFrame, str, str, str]:
    """The rows with base spans and runs, and behind them rows that hold counts of pairs; and the names of the added columns.

    Rows of counts have null in `keep` and in the list of spans; their pairs stand in the counts column as (cell, n).
    """
    spans, found, counts = (fresh(docs, n) for n in ("spans", "runs", "counts"))
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").alias(fresh(docs, "scanned")))
    added = [
        StructField(spans, ArrayType(SPAN)),
        StructField(found, ArrayType(RUN)),
        StructField(counts, ArrayType(LongType())),
    ]
    fields = [StructField(f.name, f.dataType, True) for f in (docs.schema[c] for c in keep)]
    names = [*keep, spans, found, counts]
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    count_type = pa.list_(pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, random = np.zeros(STATES * STATES, np.int64), np.zeros(STATES * STATES, np.int64)
        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            span_rows, run_rows = [], []
            for data in row_bytes(batch.column(len(keep))):
                ordinary += pair_counts(np.frombuffer(data, np.uint8))
                base = base_spans(data)
                last = 0
                for _, _, end, value in base:
                    if value >= last:
                        own = pair_counts(np.frombuffer(data[value:end], np.uint8))
                        ordinary -= own
                        random += own
                        last = end
                free = apart(runs(data), base)
                at = chars(data, [p for _, a, b, _ in base for p in (a, b)]) if base else []
                span_rows.append([{"kind": s[0], "start": at[2 * i], "end": at[2 * i + 1]} for i, s in enumerate(base)])
                at = chars(data, [p for r in free for p in r]) if free else []
                run_rows.append([{"start": at[2 * i], "end": at[2 * i + 1], "text": data[a:b].decode()} for i, (a, b) in enumerate(free)])
            arrays = [pa.array(span_rows, span_type), pa.array(run_rows, run_type), pa.nulls(batch.num_rows, count_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names)
        if kinds is not None:
            pairs = [[k, c, int(n)] for k, table in enumerate((ordinary, random)) for c, n in enumerate(table) if n > 0]
            if pairs:
                blank = [pa.nulls(len(pairs), t) for t in (*kinds, span_type, run_type)]
                yield pa.RecordBatch.from_arrays([*blank, pa.array(pairs, count_type)], names)

    return map_batches(slim, scan, [*fields, *added]), spans, found, counts


def ratios(cells: list[tuple[int, int, int]]) -> np.ndarray:
    """Log-likelihood ratio of each pair of states, from rows (model, cell, n).

    The random model is half its samples, half even over all key characters, so that keys in an alphabet that the samples
    lack are found too; without samples it is even. Both are smoothed by adding to every cell.
    """
    counts = np.zeros((2, STATES, STATES))
    for model, cell, n in cells:
        counts[model, cell // STATES, cell % STATES] += n
    keys = np.flatnonzero(np.bincount([STATE[c] for c in KEY_BYTES], minlength=STATES))
    even = np.full(STATES, 1e-9)
    even[keys] = 1.0 / len(keys)
    even[0] = 1.0 / len(keys)
    even /= even.sum()
    smooth = counts + np.where(np.arange(2) == 0, 0.5, 0.0)[:, None, None]
    smooth = np.maximum(smooth, 0.0)
    total = smooth.sum(axis=2, keepdims=True)
    share = np.divide(smooth, total, out=np.zeros_like(smooth), where=total > 0)
    random = np.where(total[1] > 0, 0.5 * share[1] + 0.5 * even, even)
    return np.log(random) - np.log(share[0])


def ratio(table: np.ndarray, text: str) -> float:
    """Of a whole run, both edges included."""
    states = np.concatenate([[0], STATE[np.frombuffer(text.encode(), np.uint8)], [0]])
    return float(table[states[:-1], states[1:]].sum())


def _model(rows: DataFrame, counts: str) -> np.ndarray:
    """Both models, from at most 2 * STATES^2 sums."""
    cell = F.col(counts)
    sums = rows.filter(cell.isNotNull()).groupBy(cell[0].alias("m"), cell[1].alias("c")).agg(F.sum(cell[2]).alias("n"))
    return ratios([(r["m"], r["c"], r["n"]) for r in sums.collect()])


def _all_spans(table: np.ndarray, base: list[dict], found: list[dict]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans and of the runs held for random, sorted."""
    spans = [(s["start"], s["kind"], s["end"]) for s in base]
    spans += [(r["start"], KINDS.index("markov"), r["end"]) for r in found if ratio(table, r["text"]) >= CUT]
    return sorted(spans)


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row; offsets are code points, the end exclusive.

    A null text is an empty one: no spans, and the digest of the empty string. Repeated rows are judged each for itself; an
    empty table gives no rows. A run is reported without what a pattern matches of it; pieces under MIN_RUN are not looked at.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows, spans, found, counts = scanned(slim, ["id"], "text")
    rows = materialize(rows)
    model = docs.sparkSession.sparkContext.broadcast(_model(rows, counts))
    kind = dict(slim.dtypes)["id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, runs_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = _all_spans(model.value, base, runs_)
                numbers = [sum(kind == k for _, kind, _ in own) for k in range(4)]
                plain = _text([s for s in own if s[1] < 3])
                out.append([*numbers, hashlib.sha256(plain.encode()).hexdigest(), _text(own)])
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                [id_column, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    schema = f"`{id_column}` {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return arrow_map(rows.filter(F.col(counts).isNull()).select("id", spans, found), judge, schema)


def redact(docs: DataFrame, text_column: str = "text", size_column: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The rows of `docs` with every span of a secret replaced by `mark`; overlapping spans are one.

    Columns and their order stay; `size_column`, if there is one, is set to the new length where the text has changed.
    """
    rows, spans, found, counts = scanned(docs, docs.columns, text_column)
    rows = materialize(rows)
    model = docs.sparkSession.sparkContext.broadcast(_model(rows, counts))
    at = docs.columns.index(text_column)
    changed = fresh(docs, "changed")

    def strike(text: str, own: list[tuple[int, int, int]]) -> str:
        out, last = [], 0
        for start, _, end in own:
            if end > last:
                out += [text[last:start], mark] if start >= last else []
                last = end
        return "".join(out) + text[last:]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(docs_columns)
            own = [_all_spans(model.value, b, r) for b, r in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            texts = batch.column(at)
            if any(own):
                texts = pa.array([strike(t, s) if s else t for t, s in zip(texts.to_pylist(), own)], texts.type)
            columns = [*batch.columns[:n], pa.array([bool(s) for s in own], pa.bool_())]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, [*docs_columns, changed])

    docs_columns = docs.columns
    plain = rows.filter(F.col(counts).isNull()).drop(counts)
    out = map_batches(plain, judge, [*docs.schema.fields, StructField(changed, BooleanType())])
    if size_column in docs.columns:
        length = F.char_length(F.col(f"`{text_column}`")).cast(docs.schema[size_column].dataType)
        out = out.withColumn(size_column, F.when(F.col(changed), length).otherwise(F.col(f"`{size_column}`")))
    return out.drop(changed)
