"""Near-duplicates by Jaccard similarity against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from epochal.llm import simhash, similar

from .common import SF, frame, odd_texts, words
from .test_simhash import brute_components, brute_fingerprint


def brute_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_kept(docs):
    """The least doc_id of each group that SimHash links or a similarity of 0.8 makes."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    low = brute_components(prints)
    for i, f in prints:
        link(i, low[f])
    sets = [(i, brute_set(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * (n := len(a & b)) >= 4 * (len(a) + len(b) - n):
                link(i, j)
    return sorted({find(i) for i in parent})


def near_copies(rng, n, changes, base=200):
    """A text of ``base`` words, and copies of it with so many words changed."""
    text = [f"w{rng.randrange(5000)}" for _ in range(base)]
    out = [" ".join(text)]
    for _ in range(n):
        own = list(text)
        for at in rng.sample(range(base), changes):
            own[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_stage_links_what_is_similar(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_near_copies_and_odd_rows(spark):
    rng = random.Random(7)
    texts = [*odd_texts(), *odd_texts()]
    for changes in range(1, 8):  # similarity from above 0.95 to below 0.8
        texts += near_copies(rng, 3, changes)
    got = similar.keep_one_similar(frame(spark, texts))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(list(enumerate(texts)))


def test_large_groups_keep_one(spark):
    rng = random.Random(8)
    texts = near_copies(rng, 200, 1)
    assert [r.doc_id for r in similar.keep_one_similar(frame(spark, texts)).collect()] == [0]


def test_chains_inside_a_bucket(spark):
    """Copies whose changed words lie apart are not similar to each other, but chains of those beside each other are."""
    base = [f"w{k}" for k in range(70)]
    texts = []
    for i in range(400):
        own = list(base)
        own[i % 64] = f"x{i}"
        texts.append(" ".join(own))
    rng = random.Random(1)
    rng.shuffle(texts)
    got = similar.keep_one_similar(frame(spark, texts))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(list(enumerate(texts)))


def test_forest(monkeypatch):
    rng = np.random.default_rng(5)
    for matrix in (1 << 22, 0):
        monkeypatch.setattr(similar, "_MATRIX", matrix)
        for _ in range(40):
            base = rng.choice(10_000, 40, replace=False)
            sets = [np.unique(np.append(rng.choice(base, rng.integers(30, 41), replace=False), rng.integers(10_000, 10_040, rng.integers(0, 5)))).astype(np.int32) for _ in range(12)]
            label = list(range(12))
            for x, y in similar.forest(sets):
                assert 5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y]))
                label = [label[x] if k == label[y] else k for k in label]
            for x in range(12):
                for y in range(x):
                    if 5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y])):
                        assert label[x] == label[y]


def test_forest_of_sets_that_differ_in_what_is_their_own(monkeypatch):
    """Sets with the same shingles in common with others are compared once, and link as each alone would."""
    alone = iter(range(10**6, 2 * 10**6))
    sets = [np.array([*range(20 * k, 20 * k + n), *(next(alone) for _ in range(m))], dtype=np.int32) for k in range(3) for n, m in ((20, 2), (20, 3), (18, 5), (17, 2)) for _ in range(3)]
    alike = {(x, y) for y, b in enumerate(sets) for x, a in enumerate(sets[:y]) if 5 * (n := len(np.intersect1d(a, b))) >= 4 * (len(a) + len(b) - n)}
    for matrix in (1 << 22, 0):
        monkeypatch.setattr(similar, "_MATRIX", matrix)
        links = similar.forest(sets)
        assert {(min(e), max(e)) for e in links} <= alike and groups(range(36), links) == groups(range(36), alike)


def test_buckets_beyond_one_task(spark, monkeypatch):
    """With representatives alone, groups whose members are all alike are still found whole."""
    monkeypatch.setattr(similar, "BUCKET_SHINGLES", 10)
    texts = near_copies(random.Random(8), 60, 1)
    assert [r.doc_id for r in similar.keep_one_similar(frame(spark, texts)).collect()] == [0]


def groups(nodes, links):
    """The least node that links reach, for each."""
    label = {x: x for x in nodes}
    for u, v in links:
        low, high = sorted((label[u], label[v]))
        if low != high:
            label = {x: low if y == high else y for x, y in label.items()}
    return label


def chain_texts(n, seed):
    base = [f"w{k}" for k in range(70)]
    texts = []
    for i in range(n):
        own = list(base)
        own[i % 64] = f"x{i}"
        texts.append(" ".join(own))
    random.Random(seed).shuffle(texts)
    return texts


def test_no_link_is_lost_in_buckets_beyond_one_task(spark, monkeypatch):
    """All sets in one bucket, so no other one helps: chains, strays that are like each other alone, and sets of other sizes."""
    texts = chain_texts(300, 2)
    far = [f"w{k}" for k in range(70)]
    far[::9] = [f"far{k}" for k in range(8)]
    texts += [" ".join([*far, f"end{k}"]) for k in range(6)]
    texts += near_copies(random.Random(9), 20, 7)
    docs = frame(spark, texts)
    signatures = docs.select(F.xxhash64("text").alias("content"), "text").mapInArrow(similar._signatures, "content long, node long, bands array<long>, size long")
    signatures = signatures.withColumn("bands", F.array(F.lit(1).cast("long")))
    sets = {similar._node(s): s for s in map(similar.shingle_set, texts)}
    alike = [(u, v) for u, x in sets.items() for v, y in sets.items() if u < v and 5 * (n := len(np.intersect1d(x, y))) >= 4 * (len(x) + len(y) - n)]
    want = groups(sets, alike)
    assert len({*want.values()}) > 2
    for most in (400, 3000, 10_000, 1 << 24):
        monkeypatch.setattr(similar, "BUCKET_SHINGLES", most)
        got = [(r.u, r.v) for r in similar.similar_sets(docs, signatures).collect()]
        assert {(min(x), max(x)) for x in got if x[0] != x[1]} <= set(alike)
        assert groups(sets, got) == want, most


def test_clashing_names(spark):
    names = ["_id", "__id", "_content", "content", "root", "n", "__content", "_text", "__text"]
    rows = spark.createDataFrame([(i, t, *range(70, 70 + len(names))) for i, t in enumerate(["a b c d e f", "a b c d e f", "x"])], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for keep in (similar.keep_one_similar, simhash.keep_one):
        got = sorted(map(tuple, keep(rows).collect()))
        assert got == [(i, t, *range(70, 70 + len(names))) for i, t in ((0, "a b c d e f"), (2, "x"))]


def test_empty(spark):
    assert similar.keep_one_similar(frame(spark, [])).count() == 0
