"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from stayline.llm import backoff, decontaminate, language, lengths, licenses, mixing, nearcopies, quality, rules, secrets, simhash

NEAR = {"score": 1e-9}

PER_ROW = {
    "op1": lambda d, b, q: simhash.near_duplicates(d),
    "op2": lambda d, b, q: decontaminate.contamination(d, b),
    "op3": lambda d, b, q: licenses.find_licenses(d),
    "op4": lambda d, b, q: language.predictions(d),
    "op6": lambda d, b, q: secrets.find_secrets(d),
    "op7": lambda d, b, q: backoff.score(d),
    "op8": lambda d, b, q: mixing.mix(d),
    "op9": lambda d, b, q: quality.predictions(d, q),
    "op10": lambda d, b, q: rules.judged(d),
}
FILTERS = {
    "one_of_each": lambda d, b, q: nearcopies.one_of_each(d),
    "clean": lambda d, b, q: decontaminate.clean(d, b),
    "redact": lambda d, b, q: secrets.redact(d),
    "keep_good": lambda d, b, q: quality.keep_good(d, q),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(name, docs, benchmark, labels):
    out = PER_ROW[name](docs, benchmark, labels)
    ids = sorted(str(r[0]) for r in out.select("doc_id").collect())
    assert ids == sorted(str(r[0]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", PER_ROW)
def test_reruns_and_partitions_agree(name, docs, benchmark, labels):
    def rows(d):
        out = PER_ROW[name](d, benchmark, labels)
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in out.collect())

    # The order in which a fit sees its rows is that of a hash; nothing depends on files or partitions.
    assert rows(docs) == rows(docs.orderBy(F.rand(5)).repartition(7))


@pytest.mark.parametrize("name", [*PER_ROW, *FILTERS])
def test_empty_tables(name, docs, benchmark, labels):
    make = (PER_ROW | FILTERS)[name]
    assert make(docs.limit(0), benchmark.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(name, docs, benchmark, labels):
    out = FILTERS[name](docs, benchmark, labels)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert out.count() > 0


def test_filters_without_anything_to_learn_or_find(docs, benchmark, labels):
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()
    # Nothing learned: all scores are one half, and the threshold decides.
    scores = quality.predictions(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in scores] == [0.5]
    assert {r[0] for r in language.identify(docs, {}).select("lang_pred").collect()} == {"und"}


def test_null_and_blank_rows(docs, benchmark, labels):
    blank = F.col("doc_id").isin(100, 101, 102)
    prints = simhash.near_duplicates(docs).filter(blank).collect()
    assert {r.fingerprint for r in prints} == {"0" * 16} and {r.component_id for r in prints} == {100}
    assert {(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, benchmark).filter(blank).collect()} == {(0, 0, False)}
    assert {(r.n_words, r.labels, r.first_word, r.score) for r in licenses.find_licenses(docs).filter(blank).collect()} == {(0, "", None, 0.0)}
    assert {(r.lang_pred, r.score) for r in language.predictions(docs).filter(blank).collect()} == {("und", 0.0)}
    assert {(r.n_assign, r.spans) for r in secrets.find_secrets(docs).filter(blank).collect()} == {(0, "")}
    assert {(r.n_words, r.log_score, r.per_word) for r in backoff.score(docs).filter(blank).collect()} == {(0, 0.0, None)}
    assert {(r["size"], r.taken) for r in mixing.mix(docs).filter(blank).collect()} == {(0, 0)}
    assert {(r.n_words, r.base_failed, r.kept) for r in rules.judged(docs).filter(blank).collect()} == {(0, True, False)}
    assert len({r.score for r in quality.predictions(docs, labels).filter(blank).collect()}) == 1


def test_length_report_of_odd_rows(docs):
    report = {r.n_tokens: r for r in lengths.length_report(docs).collect()}
    assert report[0].n_docs == 3 and report[0].docs_from == docs.count() and report[0].truncated_total == 0
    assert lengths.length_report(docs.limit(0)).count() == 0
