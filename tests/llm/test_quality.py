"""The line field: marginals against enumeration, features of odd texts, and held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa

from epochal.llm import quality

from .common import SF, frame, odd_texts


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([5, 3, 3, 1])
    evidence, ties = np.zeros((4, 5)), rng.normal(size=(2, 2))
    for i, c in enumerate(counts):
        evidence[i, :c] = rng.normal(size=c)
    good, pairs, total = quality.marginals(evidence, counts, ties)
    want_pairs = np.zeros((2, 2))
    for i, c in enumerate(counts):
        mass, chance, seen = 0.0, np.zeros(c), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(c)):
            w = np.exp(sum(evidence[i, t] * y[t] for t in range(c)) + sum(ties[y[t - 1], y[t]] for t in range(1, c)))
            mass += w
            chance += w * np.array(y)
            for t in range(1, c):
                seen[y[t - 1], y[t]] += w
        assert np.allclose(good[i, :c], chance / mass) and np.isclose(total[i], np.log(mass))
        want_pairs += seen / mass
    assert np.allclose(pairs, want_pairs)


def test_features_of_each_text_alone_and_together():
    texts = pa.array([t or "" for t in odd_texts()], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    doc, size, f = quality.line_features(data, offsets)
    assert np.bincount(doc).tolist() == [(t or "").count("\n") + 1 for t in odd_texts()] and np.isfinite(f).all()
    assert size.tolist() == [len(x.encode()) for t in odd_texts() for x in (t or "").split("\n")]
    for i, t in enumerate(odd_texts()):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, _, own = quality.line_features(raw, np.array([0, len(raw)]))
        assert np.allclose(own, f[doc == i]), t


def test_document_score_by_hand():
    """A document's score from its lines' chances by enumeration, weighted by their lengths."""
    rng = np.random.default_rng(7)
    field = quality.Field(rng.normal(size=quality.N_FEATURES).astype(np.float32), rng.normal(size=(2, 2)), 1.5, -0.3)
    texts = ["", "one line", "Two lines!\nof text | here", "a\n\nb c d\nE F", "x\ny\nz\nlonger line of words\n1 2 3\n!!!"]
    big = pa.array(texts, pa.large_string())
    doc, size, f = quality.line_features(np.frombuffer(big.buffers()[2], np.uint8), np.frombuffer(big.buffers()[1], np.int64))
    got = field.scores(field.means(np.bincount(doc, minlength=len(texts)), size, f))
    for i in range(len(texts)):
        evidence, sizes = (f[doc == i] @ field.weights).astype(float), size[doc == i]
        mass, chance = 0.0, np.zeros(len(sizes))
        for y in itertools.product((0, 1), repeat=len(sizes)):
            w = np.exp(sum(e * b for e, b in zip(evidence, y)) + sum(field.ties[a, b] for a, b in zip(y, y[1:])))
            mass += w
            chance += w * np.array(y)
        mean = np.clip(((sizes + 1) * chance / mass).sum() / (sizes + 1).sum(), 1e-4, 1 - 1e-4)
        assert np.isclose(got[i], 1 / (1 + np.exp(-(1.5 * np.log(mean / (1 - mean)) - 0.3))))


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.unionByName(frame(spark, odd_texts(), 10**6).select("doc_id", "text"), allowMissingColumns=True)
    got = quality.score(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    a, b = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (a[:, None] > b[None]).mean() > 0.97 and (both.predicted == both.quality).mean() > 0.95


def test_without_labels(spark):
    df = frame(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    same = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.score(df, same).collect()} == {1}
    kept = quality.keep_good(df, none).collect()
    assert len(kept) == len(odd_texts()) and kept[0].text is None and {(r.key, r["_text"]) for r in kept} == {(7, "own")}
    assert quality.score(frame(spark, []), none).count() == 0
