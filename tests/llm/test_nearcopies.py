from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from conftest import prose
from stayline.llm import nearcopies, simhash
from test_brute import roots


def alike(texts):
    """Pairs of ids with a Jaccard similarity of 0.8 or more on five-word shingles; exact, by an index of rare shingles."""
    sets, index, pairs = {}, defaultdict(list), []
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        size = min(5, len(words))
        if words:
            sets[i] = frozenset(b" ".join(words[k : k + size]) for k in range(len(words) - size + 1))
    often = Counter(s for own in sets.values() for s in own)
    for i in sorted(sets, key=lambda i: len(sets[i])):
        own, near = sets[i], set()
        rare = sorted(own, key=lambda s: (often[s], s))
        for s in rare[: len(own) - -(-len(own) * 8 // 10) + 1]:
            near.update(index[s])
            index[s].append(i)
        for j in near:
            shared = len(own & sets[j])
            if 10 * shared >= 8 * (len(own) + len(sets[j]) - shared):
                pairs.append((j, i))
    return pairs


def test_stage_finds_all_similar_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    once = docs.dropDuplicates(["text"])
    texts = {r.doc_id: r.text for r in once.collect()}
    pairs = alike(texts)
    links = [(r.component_id, r.doc_id) for r in simhash.near_duplicates(once).collect()]
    found = dict(map(reversed, links))
    assert len([1 for a, b in pairs if found[a] != found[b]]) > 20
    wanted = {i for i, root in roots(sorted(texts), links + pairs).items() if i == root}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, once, "").collect()} == wanted


def test_crowds_stay_whole(spark):
    """100 copies with a few edited stretches each, which share keys; chains of copies; strangers that share half."""
    words = prose(1, 400).split()
    texts = {}
    for i in range(100):
        own = list(words)
        for k in range(1 + i % 5):
            at = (37 * i + 71 * k) % 395
            own[at : at + 3] = [f"a{i}x{k}"] * 3
        texts[i] = " ".join(own)
    for i in range(6):
        texts[200 + i] = " ".join([*(f"c{k}" for k in range(i)), *words[i * 30 : 200], *(f"d{k}" for k in range(i * 30))])
    half = prose(2, 150)
    texts |= {300 + i: f"{half} {prose(50 + i, 150)}" for i in range(60)}
    texts |= {400: "one two three", 401: "one  TWO three", 402: "", 403: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    links = [(r.component_id, r.doc_id) for r in simhash.near_duplicates(docs).collect()]
    wanted = {i for i, root in roots(sorted(texts), links + alike(texts)).items() if i == root}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == wanted


def test_large_keys_in_blocks(spark, monkeypatch):
    """Keys cut into blocks of 8: families of near copies, and strangers that share most of a passage, by brute force."""
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    texts = {}
    for family in range(4):
        words = prose(100 + family, 300).split()
        for i in range(40):
            own = list(words)
            for k in range(1 + i % 4):
                at = (53 * i + 61 * k) % 290
                own[at : at + 2] = [f"x{family}y{i}z{k}"] * 2
            texts[100 * family + i] = " ".join(own)
    passage = prose(7, 200)
    texts |= {1000 + i: f"{passage} {prose(2000 + i, 60 + i)}" for i in range(70)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    links = [(r.component_id, r.doc_id) for r in simhash.near_duplicates(docs).collect()]
    wanted = {i for i, root in roots(sorted(texts), links + alike(texts)).items() if i == root}
    assert {r.doc_id for r in nearcopies.one_of_each(docs).collect()} == wanted


def test_a_block_gives_the_likeliest_pair_of_two_classes():
    """Every pair of unlike classes with its greatest (agreement, a, b) and number, against plain loops; all pairs on request."""
    rng = np.random.default_rng(5)
    families = rng.integers(0, 1 << 16, (3, 128), np.uint16)
    rows = []
    for number in range(90):
        marks = families[number % 3].copy()
        changed = rng.random(128) < rng.choice([0.0, 0.1, 0.2])
        marks[changed] = rng.integers(0, 1 << 16, changed.sum(), np.uint16)
        rows.append((number // 45, int(rng.integers(-500, 500)) * 100 + number, int(rng.integers(0, 6)), marks))
    want = defaultdict(list)
    for x in rows:
        for y in rows:
            agree = int((x[3] == y[3]).sum())
            if x[0] == y[0] and x[2] < y[2] and agree >= nearcopies.LIKELY:
                want[x[0], x[2], y[2]].append((agree, x[1], y[1]))
    table = pa.table([pa.array([r[i] for r in rows]) for i in range(3)] + [pa.array([r[3].tobytes() for r in rows])], ["part", "set", "class", "sketch"])
    batches = table.to_batches(max_chunksize=7)
    best = [row for found in nearcopies.cross(nearcopies.LIKELY, False)(iter(batches)) for row in found.to_pylist()]
    assert len(want) > 10 and max(map(len, want.values())) > 5
    assert sorted((r["p"], r["q"], r["agree"], r["a"], r["b"], r["n"]) for r in best) == sorted(
        (p, q, *max(pairs), len(pairs)) for (_, p, q), pairs in want.items()
    )
    every = [row for found in nearcopies.cross(nearcopies.LIKELY, True)(iter(batches)) for row in found.to_pylist()]
    assert sorted((r["agree"], r["a"], r["b"]) for r in every) == sorted(pair for pairs in want.values() for pair in pairs)


def test_a_crowd_of_strangers_gives_rows_not_pairs(spark, monkeypatch):
    """120 texts at about 0.7 of each other, all of them likely pairs: no step makes more rows than the sets have keys."""
    passage = prose(11, 340).split()
    texts = {i: " ".join([*passage, *prose(3000 + i, 72).split()]) for i in range(120)}
    assert not alike(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    made, plain = [], nearcopies.arrow_map

    def counted(df, scan, schema):
        out = plain(df, scan, schema)
        made.append(out.count())
        return out

    classes = simhash.near_duplicates(docs).select("component_id").distinct().count()
    monkeypatch.setattr(nearcopies, "arrow_map", counted)
    assert nearcopies.one_of_each(docs).count() == classes > 110
    assert max(made) <= nearcopies.BANDS * len(texts)


def test_spanning_links_against_plain_loops():
    """Parts cut over batches: the links connect what plain Jaccard similarities connect, with fewer rows than classes."""
    rng = np.random.default_rng(8)
    rows = []
    for part in range(-3, 3):
        base = rng.integers(0, 1 << 63, 200, np.uint64)
        for _ in range(12):
            own = np.unique(np.where(rng.random(200) < rng.choice([0.0, 0.05, 0.15]), rng.integers(0, 1 << 63, 200, np.uint64), base))
            rows.append((part, len(rows), int(rng.integers(0, 9)) - 4, own))
    table = pa.table([pa.array([r[i] for r in rows]) for i in range(3)] + [pa.array([r[3].tobytes() for r in rows])], ["part", "set", "class", "hashes"])
    found = [tuple(r.values()) for out in nearcopies.spanning(iter(table.to_batches(max_chunksize=5))) for r in out.to_pylist()]
    pairs, classes = [], 0
    for part in range(-3, 3):
        own = [r for r in rows if r[0] == part]
        classes += len({r[2] for r in own}) - 1
        pairs += [(x[2], y[2]) for x in own for y in own if x[2] < y[2] and 10 * len(np.intersect1d(x[3], y[3])) >= 8 * len(np.union1d(x[3], y[3]))]
    assert pairs and len(found) <= classes and set(found) <= set(pairs)
    assert roots(range(-4, 5), found) == roots(range(-4, 5), pairs)
    assert nearcopies.shared_counts([np.array([1, 2], np.uint64), np.array([2, 3, 9], np.uint64), np.array([], np.uint64)]).tolist() == [[1, 1, 0], [1, 1, 0], [0, 0, 0]]
