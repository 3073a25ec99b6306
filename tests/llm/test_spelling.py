"""op13 against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stayline.llm import spelling
from stayline.llm.queries import REGISTRY


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts):
    """{word: (form, root, n, n_near, form_n)}, by one dropped letter or one hole of each word."""
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
    out = {}
    for w, n in counts.items():
        shorter = {w[:i] + w[i + 1 :] for i in range(len(w))} & counts.keys()
        same = set().union(*(holes[i, w[:i], w[i + 1 :]] for i in range(len(w))))
        longer = set().union(*(holes.get((i, w[:i], w[i:]), set()) for i in range(len(w) + 1)))
        close = (shorter | same | longer) - {w}
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[w] = (form, n, len(close), counts.get(form))

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), low)):
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 2 and len(w) >= 7}


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("crowd, letters, sizes", [(1024, "abé", (7, 9)), (3, "abé", (7, 9)), (2, "ab", (7, 12)), (0, "aÿ", (1, 8))])
def test_near_words_against_brute_force(spark, monkeypatch, crowd, letters, sizes):
    """Crowded lists (more than `crowd` words) and plain ones give the same pairs."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    random.seed(crowd)
    counts = {}
    while len(counts) < 200:
        word = "".join(random.choice(letters) for _ in range(random.randint(*sizes)))
        at, letter = random.randrange(len(word)), random.choice(letters)
        for w in (word, word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]):
            if w and random.random() < 0.7:
                counts[w] = random.choice([2, 3, 20, 30, 200, 300, 3000, 5_000_000])
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert collected(got) == plain_variants(counts)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    wanted = plain_variants(plain_counts(rows))
    assert collected(REGISTRY["op13_spelling"](spark, folder)) == wanted
    assert sum(v[0] is not None for v in wanted.values()) > 100


def test_chains_ties_and_long_words(spark):
    long = "ab" * 3000
    counts = {
        "variant": 5000, "variann": 400, "varian": 30, "varia": 2,
        "letterx": 7, "letterb": 70, "lettera": 70,
        long: 2, long[:-1]: 50, "c" + long: 700,
    }
    got = collected(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got["varia"][:2] == ("varian", "variant") and got["varian"][0] == "variant" and got["variann"] == ("variant", "variant", 400, 2, 5000)
    assert got["letterx"] == ("lettera", "lettera", 7, 2, 70) and got["lettera"][0] is None
    assert got[long] == ("c" + long, "c" + long, 2, 2, 700) and got[long[:-1]][3] == 1


def test_odd_rows(spark, docs):
    odd = docs.select("doc_id", "text", F.lit(1).alias("word"), F.lit(2).alias("n"))
    counts = spelling.word_counts(odd, spelled=spelling.dropped_letter)
    assert {r.word: r.n for r in counts.collect()} == plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    empty = spelling.variants(spelling.word_counts(docs.limit(0)))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    upper = spark.createDataFrame([(1, "ÀBCDEFGH àbcdefgh Àbcdefgh x " * 2)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(upper).collect()} == {"Àbcdefgh": 4, "àbcdefgh": 2}
    with pytest.raises(ValueError):
        spelling.variants(counts, ratio=1)


def test_batches_cut_lists(spark, monkeypatch):
    """A list that spans Arrow batches is scanned as one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        random.seed(5)
        counts = {"abcdefg" + "".join(random.choice("xyz") for _ in range(3)): random.randint(2, 900) for _ in range(30)}
        got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
        assert collected(got) == plain_variants(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
