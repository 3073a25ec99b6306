"""Language identification by compression.

Every language has a raw-content dictionary of its own text. A text is cut into chunks of 1 kB, each chunk is
compressed once with each dictionary, and the language whose dictionary leaves the fewest bytes over the whole text wins.
Chunks keep the dictionaries useful to the end of a long text. A narrow margin is reported as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import arrow_map, held_out, row_bytes, uniform

#: A fit learns from at most SAMPLE different texts of a language, of each a stretch of at most TEXT_CHARS characters at a seeded
#: place; the DICTIONARY bytes of the language are shared out over all of them.
SAMPLE = 200
TEXT_CHARS = 2000
DICTIONARY = 32 << 10
CHUNK = 1024
LEVEL = 12
#: Share of the second-best size by which the best must be smaller; less is a rejection.
MARGIN = 0.01
UNKNOWN = "und"


def _letters_only() -> bytes:
    """ASCII letters and bytes above ASCII stay, all else is a blank."""
    return bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


LETTERS_ONLY = _letters_only()


def plain(data: bytes) -> bytes:
    """Lower case, one blank for anything but letters; empty if the text has no letter."""
    text = data.decode(errors="replace").lower()
    if not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.encode().translate(LETTERS_ONLY).split())


def shared_out(sizes: list[int], total: int) -> list[int]:
    """Bytes that each of several texts gives: all alike, short ones whole, and what those leave goes to the others."""
    given, open_ = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    for done, i in enumerate(open_):
        given[i] = min(sizes[i], total // (len(sizes) - done))
        total -= given[i]
    return given


def dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """The plain beginnings of the texts, `size` bytes at most, shared out over all of them."""
    own = [data for data in (plain(t.encode()) for t in texts) if data]
    # One byte a text is the blank between two.
    return b" ".join(data[:n] for data, n in zip(own, shared_out([len(d) for d in own], size - len(own))) if n > 0)


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, order, text) of at most `sample` different texts of each language, a stretch of each; rows: lang and text.

    The draw goes by a hash of the text: ids play no part, whether null or repeated, and copies count once. A first bound by the
    estimated number of different texts leaves about twice the sample to rank, so that no language is ranked as a whole.
    """
    rows = rows.withColumn("order", uniform("text", seed=4))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("kinds"))
    # One row a language.
    few = rows.join(F.broadcast(kinds), "lang").filter(F.col("order") * F.col("kinds") < 2 * sample)
    place = F.floor(uniform("text", seed=44) * F.greatest(F.char_length("text") - TEXT_CHARS, F.lit(0))).cast("int") + 1
    few = few.select("lang", "order", F.substring("text", place, TEXT_CHARS).alias("text")).distinct()
    return few.withColumn("rank", F.expr("row_number() over (partition by lang order by order, text)")).filter(F.col("rank") <= sample).drop("rank")


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> dict[str, bytes]:
    """A dictionary for every language of the rows that are not held out, from a seeded sample of bounded size.

    Rows without text or language teach nothing, and a language without a letter in its texts is not learned. The number of languages is that of the label
    column's values.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(language_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    known = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    texts: dict[str, list] = {}
    for row in sampled(known).collect():
        texts.setdefault(row["lang"], []).append((row["order"], row["text"]))
    learned = {lang: dictionary([t for _, t in sorted(own)]) for lang, own in sorted(texts.items())}
    return {lang: content for lang, content in learned.items() if content}


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    """One for each dictionary; built once a worker."""
    out = []
    for content in dictionaries:
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if len(content) >= 8:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            options["dict_data"] = own
        out.append(zstandard.ZstdCompressor(**options))
    return out


def sizes(data: bytes, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that the whole text takes with each dictionary."""
    total = np.zeros(len(compressors))
    for low in range(0, len(data), CHUNK):
        part = data[low : low + CHUNK]
        total += [len(c.compress(part)) for c in compressors]
    return total


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row.

    score is 1 / sum over languages of 2^-(bits beyond the best, an eighth of them): near 1 if the best stands alone. Texts
    without a letter, null texts, and every text if nothing was learned, are `und`, with score 0 and rejected. A draw goes to
    the language that sorts first.
    """
    names = sorted(dictionaries)
    contents = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries[n] for n in names))
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(contents.value)
        for batch in batches:
            found, scores, rejected = [], [], []
            for data in row_bytes(batch.column(1)):
                data = plain(data)
                if not data or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                size = sizes(data, compressors)
                best = int(size.argmin())
                found.append(names[best])
                scores.append(float(1.0 / np.exp2(size[best] - size).sum()))
                rest = np.delete(size, best)
                rejected.append(bool(len(rest)) and bool(rest.min() - size[best] < MARGIN * rest.min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = dict(slim.dtypes)["id"]
    return arrow_map(slim, scan, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_column)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): fitted on the rows that are not held out, applied to all."""
    return identify(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id")))
