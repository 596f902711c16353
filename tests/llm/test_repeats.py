"""Removal of repeated bytes and words against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from epochal.llm import rlz, suffixes
from epochal.llm.external import BucketQueue, Space, Tape
from epochal.llm.repeats import byte_symbols, word_symbols
from epochal.llm.segments import cut, gram_hashes, sliding_minimum

from .common import frame, odd_texts, sample_texts


def brute(units, window):
    """For each text, which units are covered by a window that starts twice or more."""
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        hit = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                hit[i : i + window] = [True] * window
        out.append(hit)
    return out


def spans_of(hit):
    return sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))


def made_texts(rng):
    words = ["alpha", "beta", "gamma", "déjà", "omega", "x", "the", "of"]
    phrase = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    shared = [phrase(rng.randint(4, 40)) for _ in range(6)]
    texts = [" ".join(rng.choice([phrase(rng.randint(1, 9)), rng.choice(shared)]) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    texts += [texts[0]] * 5 + ["a" * 300, "a" * 90, "ab" * 200, phrase(30) + " " + "z" * 100, " ".join(["same"] * 80)] + odd_texts()
    return texts


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64)
    for w in (1, 2, 7, 499, 500):
        assert sliding_minimum(x, w).tolist() == [int(x[i : i + w].min()) for i in range(501 - w)]
    assert len(gram_hashes(np.arange(20), 8)) == 13


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 255, 60).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(0, 255, n).astype(np.uint8), passage, rng.integers(0, 255, 50).astype(np.uint8)]) for n in (10, 33))

    flat, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    first, end, anchor, place = cut(flat, offsets, 40, 8)
    assert sorted(k for x, y in zip(first, end) for k in range(x, y)) == [*range(len(a) - 39), *range(len(a), len(a) + len(b) - 39)]

    def anchor_of(at):
        return anchor[np.searchsorted(first, at, side="right") - 1]

    assert all(anchor_of(10 + k) == anchor_of(len(a) + 33 + k) for k in range(21))
    grams = gram_hashes(flat, 8) >> np.uint64(12)
    assert (place >= 0).all() and (grams[first + place] == anchor.view(np.uint64) >> np.uint64(12)).all()


def test_long_segments_are_cut():
    x = np.zeros(10_000, dtype=np.uint8)
    first, end, anchor, place = cut(x, np.array([0, 10_000]), 40, 8)
    assert (end - first).max() == 1024 and first[0] == 0 and end[-1] == 9961 and (first[1:] == end[:-1]).all()
    assert len(set(anchor.tolist())) == 1 and (place == -1).all()


def prefix(x, i, j, most):
    k = 0
    while k < most and x[i + k] == x[j + k]:
        k += 1
    return k


def test_suffix_order_and_common_prefixes(tmp_path):
    rng, spilled = random.Random(2), 0
    for _ in range(250):
        x = [rng.randint(1, rng.choice([1, 2, 4, 9, 200])) for _ in range(rng.randint(1, rng.choice([10, 80, 300])))]
        x = (x * rng.randint(1, 3))[:400] + [0]
        reach = rng.choice([1000, 20, 8])
        space = Space(tmp_path.as_uri(), rng.choice([1 << 20, 2048, 256, 64]))  # from all in memory to recursion down to one name
        text = Tape(space, "u2")
        for k in range(0, len(x), 37):
            text.append(np.array(x[k : k + 37]))
        got = [(p, n) for at, shared in suffixes.Sorter(text.finish(), 258, reach, space).order() for p, n in zip(at.tolist(), shared.tolist())]
        spilled += space.spilled > 0
        space.close()
        order = [p for p, _ in got]
        assert sorted(order) == list(range(len(x)))
        keys = [x[p : p + reach] for p in order]
        assert keys == sorted(keys, reverse=True), x
        assert [n for _, n in got] == [0] + [prefix(x, p, q, reach) for p, q in zip(order, order[1:])]
    assert spilled > 50 and not any(tmp_path.iterdir())


def test_shard_beyond_memory(tmp_path):
    """The whole kernel with a queue, text and names that must go to files, against the same in memory."""
    rng = np.random.default_rng(5)
    shared = [rng.integers(97, 105, 700).astype(np.uint8) for _ in range(4)]
    segments = [np.concatenate([rng.integers(97, 105, rng.integers(200, 900)).astype(np.uint8), shared[k % 4][k % 7 :]]) for k in range(60)]
    found = []
    for space in (Space(), Space(tmp_path.as_uri(), 16 << 10)):
        kernel = suffixes.SuffixKernel(400, space)
        for s in segments:
            kernel.add(s)
        hit = {}
        for k, starts in kernel.repeats():
            hit.setdefault(k, set()).update(starts.tolist())
        found.append(hit)
        assert (space.spilled > 20 * (16 << 10)) == (space.fs is not None)
    assert found[0] == found[1] and len(found[0]) == 60


def test_queue_writes_to_disk(tmp_path):
    space = Space(tmp_path.as_uri(), 2000)
    queue, rng = BucketQueue(space), np.random.default_rng(3)
    want = {}
    for _ in range(40):
        s, p = np.sort(rng.integers(0, 5, 20)), rng.integers(0, 1000, 20).astype(np.int32)
        queue.push(s, p)
        for a, b in zip(s.tolist(), p.tolist()):
            want.setdefault(a, []).append(b)
    assert space.spilled and any(tmp_path.iterdir())
    got = {}
    while (k := queue.next()) is not None:
        while (rows := queue.take(k)) is not None:
            got.setdefault(k, []).extend(rows[0].tolist())
    assert got == want and list(got) == sorted(got)


def test_factors():
    """Factors are greedy longest matches, and boundaries hold repeats that no factor holds."""
    rng, crossing = random.Random(4), 0
    for _ in range(80):
        segments = [np.array([rng.randint(0, 3) for _ in range(rng.randint(6, 40))], dtype=np.uint64) for _ in range(rng.randint(1, 5))]
        block = rlz.ReferenceBlock(segments)
        text = np.concatenate(segments).tolist()
        ends = [e for b, e in zip(block.begin, block.end) for _ in range(b, e)]

        def longest(i):
            return max((next((k for k in range(min(ends[i] - i, ends[j] - j)) if text[i + k] != text[j + k]), min(ends[i] - i, ends[j] - j)) for j in range(len(text)) if j != i), default=0)  # noqa: B023

        start, source, length = block.factors()
        assert [max(1, longest(i)) for i in start.tolist()] == length.tolist()
        assert start.tolist() == sorted({*block.begin.tolist(), *(i + n for i, n in zip(start.tolist(), length.tolist()) if i + n < len(text))})
        assert all(text[i : i + n] == text[j : j + n] for i, j, n in zip(start.tolist(), source.tolist(), length.tolist()) if j >= 0)
        whole = {i for i in range(len(text)) if longest(i) >= 6}
        own, more = set(rlz.inside(start, source, length, 6).tolist()), set(rlz.across(block, start, length, 6).tolist())
        assert own | more == whole
        crossing += own != whole
    assert crossing > 10


def check(spark, texts, run, units, window, join, columns):
    got = {}
    for r in run(frame(spark, texts)).collect():
        got[r.doc_id] = r
    assert len(got) == len(texts)
    for i, (u, hit) in enumerate(zip(units, brute(units, window))):
        kept = join([x for x, h in zip(u, hit) if not h])
        want = (len(u), sum(hit), hashlib.sha256(kept).hexdigest())
        assert tuple(getattr(got[i], c) for c in columns) == want, (i, texts[i])
        if "n_bytes" in columns:
            assert got[i].n_spans == spans_of(hit)


def test_bytes(spark):
    texts = made_texts(random.Random(6))
    units = [list((t or "").encode()) for t in texts]
    for most in (1 << 20, 300):  # with 300, groups are cut to single windows
        check(spark, texts, lambda df, most=most: suffixes.remove_repeated_bytes(df, window=40, gram=8, group_symbols=most), units, 40, bytes, ("n_bytes", "n_removed", "kept_sha256"))


def test_words(spark):
    texts = made_texts(random.Random(8))
    units = [(t or "").encode().split() for t in texts]
    for most in (1 << 17, 40):
        check(spark, texts, lambda df, most=most: rlz.remove_repeated_words(df, window=7, gram=2, group_words=most), units, 7, b" ".join, ("n_words", "n_removed", "kept_sha256"))


def test_kernels_on_repetitive_input():
    rng = random.Random(9)
    for _ in range(60):
        raw = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 60))) for _ in range(rng.randint(1, 6))]
        seen = Counter(r[i : i + 12] for r in raw for i in range(len(r) - 11))
        want = {k: {i for i in range(len(r) - 11) if seen[r[i : i + 12]] > 1} for k, r in enumerate(raw)}
        for kind, dtype in ((suffixes.SuffixKernel, np.uint8), (rlz.FactorKernel, np.uint64)):
            kernel = kind(12, Space())
            for r in raw:
                kernel.add(np.frombuffer(r, dtype=np.uint8).astype(dtype))
            got = {k: set() for k in want}
            for k, starts in kernel.repeats():
                got[k].update(starts.tolist())
            assert got == want


def test_symbols():
    texts = pa.array(["", "ab é", "", " x  x\n"])
    flat, offsets = byte_symbols(texts)
    assert bytes(flat) == "ab é x  x\n".encode() and offsets.tolist() == [0, 0, 5, 5, 11]
    assert byte_symbols(texts.slice(1, 2))[1].tolist() == [0, 5, 5] and len(byte_symbols(pa.array([], pa.string()))[0]) == 0
    flat, offsets = word_symbols(texts)
    assert offsets.tolist() == [0, 0, 2, 2, 4] and flat[2] == flat[3]


def test_production_windows_on_documents(spark):
    docs = sample_texts(spark)
    units = [list((t or "").encode()) for _, t in docs]
    check(spark, [t for _, t in docs], suffixes.remove_repeated_bytes, units, 400, bytes, ("n_bytes", "n_removed", "kept_sha256"))
    units = [(t or "").encode().split() for _, t in docs]
    check(spark, [t for _, t in docs], rlz.remove_repeated_words, units, 35, b" ".join, ("n_words", "n_removed", "kept_sha256"))


def test_very_long_texts(spark):
    """One letter a million times, a long text twice, and one that holds the long text with other words around it."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(150_000))
    texts = ["a" * 1_000_000, long, "before\n" + long[long.index(" w", 5000) + 1 :], long, "x " * 300_000, "short"]
    got = {r.doc_id: r for r in suffixes.remove_repeated_bytes(frame(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(6)] == [1_000_000, len(long), len(texts[2]) - len("before\n"), len(long), 600_000, 0]
    got = {r.doc_id: r for r in rlz.remove_repeated_words(frame(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 150_000, len(texts[2].split()) - 1, 150_000, 300_000, 0]


def test_many_classes_of_one_anchor(spark):
    """A passage that thousands of texts hold, each with other words around it."""
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{k} a{k * 7} b{k * 11} {passage} c{k * 13} d{k}" for k in range(3000)]
    got = [r.n_removed for r in rlz.remove_repeated_words(frame(spark, texts)).collect()]
    assert got == [60] * 3000


def test_repeated_rows_and_empty(spark):
    text = "word " * 100
    rows = spark.createDataFrame([(1, text), (1, text), (None, "other " * 3)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in suffixes.remove_repeated_bytes(rows).collect())
    assert got == [(0, 0), (1, 500), (1, 500)]
    assert suffixes.remove_repeated_bytes(frame(spark, [])).count() == rlz.remove_repeated_words(frame(spark, [])).count() == 0
