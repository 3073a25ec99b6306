import corpus_pipeline
from stayline.llm import decontaminate, quality, secrets, simhash
from stayline.sources.tables import materialize
from test_brute import RUNS, WORDS, low, plain_fingerprint, plain_spans, roots
from test_nearcopies import alike

FOLDER = "/root/testdata/sf0.001"


def test_stages_hand_on_what_they_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "keep_good_quality", "drop_near_duplicates", "drop_contaminated", "strike_secrets", "mix_sources",
    ]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, FOLDER))
        kept.append(docs.count())
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontaminate.contamination(docs, benchmark).filter("contaminated").count() == 0
    assert simhash.near_duplicates(docs).filter("component_id <> doc_id").count() == 0
    assert secrets.find_secrets(docs).filter("n_assign + n_access + n_hex > 0").count() == 0
    mixed = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(mixed) == kept[-1] and 0 < sum(r.taken for r in mixed)


def test_stages_against_plain_python(spark):
    """Each stage on what the one before kept: components, similar shingle sets, shared windows, patterns and sizes by brute force."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    wanted = {r.doc_id for r in quality.predictions(docs, labels).filter("score >= 0.7").collect()}
    docs = materialize(stages["quality classifier"](spark, docs, FOLDER))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts) == wanted

    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = {i for i, root in roots(ids, near + alike(texts)).items() if i == root}
    docs = materialize(stages["near-duplicates"](spark, docs, FOLDER))
    assert {r.doc_id for r in docs.collect()} == wanted

    windows = set()
    for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = RUNS.findall(low(row.text))
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9)) if words}
    lengths = {len(w) for w in windows}

    def clean(text):
        words = RUNS.findall(low(text))
        return not any(tuple(words[k : k + n]) in windows for n in lengths for k in range(len(words) - n + 1))

    wanted = {i for i in wanted if clean(texts[i])}
    docs = materialize(stages["benchmark decontamination"](spark, docs, FOLDER))
    assert {r.doc_id for r in docs.collect()} == wanted

    docs = materialize(stages["secret scans"](spark, docs, FOLDER))
    for row in docs.collect():
        spans = plain_spans(texts[row.doc_id])
        assert (row.text == texts[row.doc_id]) == (not spans) or "[secret]" in row.text
        assert not plain_spans(row.text)
    out = {r.doc_id: r for r in stages["mixing to target weights"](spark, docs, FOLDER).collect()}
    assert {i: r["size"] for i, r in out.items()} == {r.doc_id: len(WORDS.findall(r.text)) for r in docs.collect()}
