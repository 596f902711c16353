"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from epochal.llm import simhash
from epochal.llm.graph import components

from .common import frame, odd_texts, sample_texts, words


def brute_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(docs):
    fp = {f: [] for _, f in docs}
    for i, f in docs:
        fp[f].append(i)
    nodes = list(fp)
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(nodes, dtype=np.uint64)
    for k, f in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(arr[k + 1 :] ^ arr[k]) <= 3):
            parent[find(nodes[k + 1 + j])] = find(f)
    low = {}
    for f in nodes:
        low[find(f)] = min(low.get(find(f), 1 << 60), min(fp[f]))
    return {f: low[find(f)] for f in nodes}


def test_documents(spark):
    docs = list(enumerate(odd_texts())) + [(i + 1000, t) for i, t in sample_texts(spark)]
    df = frame(spark, odd_texts()).select("doc_id", "text").unionByName(spark.createDataFrame([d for d in docs if d[0] >= 1000], "doc_id long, text string"))
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    want = brute_components(prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(got) == len(docs)
    for i, f in prints:
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", want[f])


def clustered(rng, n):
    """Fingerprints in clusters around few centres, chains of them included."""
    out = set()
    centres = [rng.getrandbits(64) for _ in range(6)]
    while len(out) < n:
        f = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
        if rng.random() < 0.05:
            centres.append(f)
    return sorted(out)


def labels_of(spark, prints, most):
    signed = [(int(np.uint64(f).view(np.int64)),) for f in prints]
    before, simhash.UNIT_ROWS = simhash.UNIT_ROWS, most
    try:
        units = simhash._units(spark.createDataFrame(signed, "fingerprint long")).repartition("unit").sortWithinPartitions("unit", "side", "turned")
        pairs = units.mapInArrow(simhash._links, "u long, v long").collect()
    finally:
        simhash.UNIT_ROWS = before
    return [(int(np.int64(u).view(np.uint64)), int(np.int64(v).view(np.uint64))) for u, v in pairs]


def test_hot_tries_are_split_without_loss(spark):
    prints = clustered(random.Random(5), 3000)
    want = brute_components([(i, f) for i, f in enumerate(prints)])
    for most in (400_000, 40):
        links = labels_of(spark, prints, most)
        assert all((u ^ v).bit_count() <= 64 for u, v in links) and len(links) < 4 * len(prints) * (1 if most > 40 else 20)
        parent = {f: f for f in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            parent[find(u)] = find(v)
        low = {}
        for i, f in enumerate(prints):
            low.setdefault(find(f), i)
        assert {f: low[find(f)] for f in prints} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
