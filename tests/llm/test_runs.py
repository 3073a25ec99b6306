"""op12 against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import runs
from stayline.llm.queries import REGISTRY

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, length, period) of every run: maximal stretches of each period, without those that have a smaller one."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                found.append((i, length, q))
            i = max(j, i + 1)
    smallest = lambda s, n, q: not any(words[s : s + n - d] == words[s + d : s + n] for d in range(1, q))
    return sorted((r for r in found if smallest(*r)), key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    words = plain_planted(doc_id, text)
    found = plain_runs(words)
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        sha(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_word_runs_against_brute_force(letters):
    random.seed(letters)
    for _ in range(500):
        n = random.randint(0, 70)
        words = [random.randrange(letters) for _ in range(n)]
        if n and random.random() < 0.5:
            a, p = random.randrange(n), random.randint(1, n)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        numbers = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        assert [tuple(r) for r in runs.word_runs(ids)] == plain_runs(words)


def test_long_texts():
    words = np.arange(100_000) % 977
    assert [tuple(r) for r in runs.word_runs(words)] == [(0, 100_000, 977)]
    assert runs.word_runs(np.arange(100_000)) == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(WORDS.findall(r.text or "")) < 1500]
    assert len(short) > 150
    got = {r.doc_id: tuple(r)[:8] for r in REGISTRY["op12_runs"](spark, folder).collect()}
    assert len(got) == len(rows)
    for r in short:
        assert got[r.doc_id] == plain_digest(r.doc_id, r.text)
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_odd_rows(spark, docs):
    odd = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(200, "a " * 12), (200, "a " * 12), (201, "a " * 11), (None, "x y " * 9)], "doc_id long, text string")
    )
    out = runs.digest(runs.periodic_runs(runs.planted(odd)))
    assert out.count() == odd.count()
    wanted = sorted(map(str, (plain_digest(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 5000)))
    got = sorted(str(tuple(r)[:8]) for r in out.filter("n_words < 5000").collect())
    assert got == wanted
    assert runs.digest(runs.periodic_runs(runs.planted(odd.limit(0)))).count() == 0
    blank = out.filter("n_words = 0").select("n_runs", "start", "length", "period", "exponent_milli").distinct().collect()
    assert [tuple(r) for r in blank] == [(0, None, None, None, None)]


def test_columns_and_clashes(docs):
    clash = docs.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))
    out = runs.periodic_runs(clash)
    assert out.columns == [*clash.columns, "_runs", "_collapsed"]
    assert out.count() == docs.count()
