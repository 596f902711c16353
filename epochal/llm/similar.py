"""Near-duplicates by the Jaccard similarity of their sets of word shingles: several fingerprints bring sets together, exact sets decide.

The join of SimHash tries cannot do this: sets of similarity 0.8 differ in 10 of 64 bits on average and in 18 at times, a budget
under which nearly all pairs of nodes stay open. So sets meet by minima, and SimHash classes are linked besides.

Each distinct set of shingles has ``BANDS`` fingerprints, each of ``ROWS`` minima under random orders. Sets that share one meet
in a bucket; a pair of similarity 0.8 shares none with a chance of 3 in 100,000. Buckets of the same sets are one. All links of a
bucket are found from the whole sets, shingle by shingle, and a spanning forest of them is given: a set is compared with those
that are not reached yet, so a group of copies costs little more than its size, and no pairs are written.

A bucket whose sets have more than ``BUCKET_SHINGLES`` shingles together does not fit one task. It is dealt into parts, and each
part is worked on whole with ``REPRESENTATIVES`` of the bucket, which ties the parts of a group of copies together. What then is
not one group is compared across parts: each set outside the bucket's largest group meets all sets of the bucket, two parts at a
time. So no link is lost; the work grows with the bucket times those sets, and with its square only if most of them stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import durable, give_back, text_of
from .simhash import classes_of, keep_first

SHINGLE, BANDS, ROWS = 5, 20, 4
BUCKET_SHINGLES, REPRESENTATIVES = 16 << 20, 16
#: Rows up to this number are broadcast.
BROADCAST_ROWS = 500_000
_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, lower-cased in A-Z; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    spans = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)))
    join, h64 = b" ".join, xxhash.xxh64_intdigest
    return np.unique(np.array([h64(join(s), 42) for s in spans], dtype=np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """The fingerprints of a set, as signed longs; none for the empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 1 << 12):
        least = np.minimum(least, ((own[at : at + (1 << 12)] ^ _FLIP) * _TIMES).min(axis=1))
    found = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(found, dtype=np.uint64).view(np.int64).tolist()


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


#: Texts whose sets are held at a time.
_AT_A_TIME = 256


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_A_TIME):
            part = batch.slice(at, _AT_A_TIME)
            yield part, [shingle_set(t.as_py()) for t in part.column(1)]
    give_back()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _shingled(batches):
        columns = [part.column(0), pa.array([_node(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["content", "node", "bands", "size"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles by the lower half of their hashes, which tells the sets of one bucket apart."""
    for _, sets in _shingled(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.astype(np.uint32).view(np.int32) for s in sets], pa.list_(pa.int32()))], names=["node", "own"])


#: Words of 64 bits that the shingles of one bucket may take as a matrix; beyond that sets meet by lists.
_MATRIX = 1 << 22
#: Shingles that are counted at a time.
_COUNTED = 1 << 20


def _by_matrix(row: np.ndarray, shingle: np.ndarray, sizes: np.ndarray, words: int) -> Callable[[int, np.ndarray, int], np.ndarray]:
    matrix = np.zeros((len(sizes), words), dtype=np.uint64)
    np.bitwise_or.at(matrix, (row, shingle // 64), np.uint64(1) << (shingle % 64).astype(np.uint64))

    def near(x: int, alive: np.ndarray, _: int) -> np.ndarray:
        left = np.flatnonzero(alive)
        n = np.bitwise_count(matrix[left] & matrix[x]).sum(axis=1, dtype=np.int64)
        return left[5 * n >= 4 * (sizes[x] + sizes[left] - n)]

    return near


def _by_lists(row: np.ndarray, shingle: np.ndarray, sizes: np.ndarray, words: int) -> Callable[[int, np.ndarray, int], np.ndarray]:
    """Two sets of similarity 0.8 share one of the rarest shingles of each, a fifth of them and one; only those are listed, of sets
    that are left, and listed again whenever half of these are gone. What meets so is counted whole."""
    times = np.bincount(shingle, minlength=64 * words)
    rank = np.empty(len(times), dtype=np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    key = row * len(times) + rank[shingle]
    key.sort()
    rank = key % len(times)
    del key
    starts = np.searchsorted(row, np.arange(len(sizes) + 1))
    own_size = np.diff(starts)
    rare = np.maximum(0, own_size - (4 * sizes + 4) // 5 + 1)  # those of one set alone come before
    listed = np.flatnonzero(np.arange(len(row)) - starts[row] < rare[row])
    mark = np.zeros(len(times), dtype=bool)
    lists = keys = at = np.zeros(0, dtype=np.int64)
    held = 0

    def near(x: int, alive: np.ndarray, n: int) -> np.ndarray:
        nonlocal listed, lists, keys, at, held
        if not held or 2 * n < held:
            listed, held = listed[alive[row[listed]]], n
            by = listed[np.argsort(rank[listed], kind="stable")]
            lists = row[by]
            keys, at = np.unique(rank[by], return_index=True)
            at = np.append(at, len(by))
        own = rank[starts[x] : starts[x] + rare[x]]
        k = np.searchsorted(keys, own)
        k = k[k < len(keys)]
        k = k[keys[k] == own[: len(k)]]
        if not len(k):
            return k
        others = np.concatenate([lists[at[i] : at[i + 1]] for i in k.tolist()])
        others = np.unique(others[alive[others]])
        others = others[(5 * sizes[others] >= 4 * sizes[x]) & (5 * sizes[x] >= 4 * sizes[others])]
        mark[rank[starts[x] : starts[x + 1]]] = True
        found, ends = [others[:0]], np.append(0, np.cumsum(own_size[others]))
        a = 0
        while a < len(others):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _COUNTED, side="right")) - 1)
            part, width = others[a:b], own_size[others[a:b]]
            where = np.arange(ends[a], ends[b]) + np.repeat(starts[part] - ends[a:b], width)
            common = np.add.reduceat(mark[rank[where]], ends[a:b] - ends[a], dtype=np.int64)
            found.append(part[5 * common >= 4 * (sizes[x] + sizes[part] - common)])
            a = b
        mark[rank[starts[x] : starts[x + 1]]] = False
        return np.concatenate(found)

    return near


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the sets (of distinct numbers) that have a similarity of 0.8 or more.

    Sets of one size that have the same shingles in common with any others are one class, which is compared once."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # others count for sizes alone
    there = shared[shingle]
    row, shingle = row[there], (np.cumsum(shared) - 1)[shingle[there]]
    if not len(row):
        return []
    starts = np.searchsorted(row, np.arange(len(sets) + 1)).tolist()
    classes: dict[tuple[int, bytes], list[int]] = {}
    for x, size in enumerate(sizes.tolist()):
        classes.setdefault((size, shingle[starts[x] : starts[x + 1]].tobytes()), []).append(x)
    members = list(classes.values())
    del classes
    number = np.full(len(sets), -1)
    number[[m[0] for m in members]] = np.arange(len(members))
    row = number[row]
    row, shingle, sizes = row[row >= 0], shingle[row >= 0], sizes[[m[0] for m in members]]
    words = (int(shared.sum()) - 1) // 64 + 1
    near = (_by_matrix if words * len(members) <= _MATRIX else _by_lists)(row, shingle, sizes, words)
    inside = 9 * np.bincount(row, minlength=len(members)) >= 8 * sizes
    edges: list[tuple[int, int]] = []
    alive, n = np.ones(len(members), dtype=bool), len(members)
    for first in range(len(members)):
        if not alive[first]:
            continue
        one, *more = members[first]
        if inside[first]:
            edges += [(one, y) for y in more]
            more = []
        alive[first], n, queue = False, n - 1, [first]
        while queue and n:
            x = queue.pop()
            found = near(x, alive, n)
            alive[found] = False
            n -= len(found)
            queue += (found := found.tolist())
            edges += [(members[x][0], y) for k in found for y in members[k]]
            if found and more:
                edges += [(members[found[0]][0], y) for y in more]
                more = []
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets, from rows (b, node, own) that come sorted by bucket."""
    bucket, nodes, sets = None, [], []
    ends: list[tuple[int, int]] = []

    def close_bucket() -> None:
        if len(sets) > 1:
            ends.extend((nodes[x], nodes[y]) for x, y in forest(sets))
        nodes.clear()
        sets.clear()

    def links() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["u", "v"])
        ends.clear()
        return found

    for batch in batches:
        own = batch.column(2)
        for k, (b, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if b != bucket:
                close_bucket()
                bucket = b
                if len(ends) > 10_000:
                    yield links()
            nodes.append(node)
            sets.append(own[k].values.to_numpy(zero_copy_only=False).copy())
    close_bucket()
    yield links()
    give_back()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _links(units: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Spanning forests of ``units`` (b, node)."""
    rows = units.join(sets, "node").select("b", "node", "own").repartition("b").sortWithinPartitions("b", "node")
    return durable(rows.mapInArrow(_forests, "u long, v long").distinct(), label)


def _across(many: DataFrame, links: DataFrame) -> DataFrame:
    """Units (b, node) in which each set outside the largest group that ``links`` make of a bucket meets all others of the bucket."""
    placed = many.join(components(links), "node", "left").select("b", "node", "size", F.coalesce("root", "node").alias("root"))
    placed = durable(placed, "placed-in-buckets")
    groups = placed.groupBy("b", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    groups = groups.groupBy("b").agg(F.max(F.struct("s", "root", "n")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("groups")).where("groups > 1")
    parts = f"least({{0}}, ceil(2 * {{1}} / {BUCKET_SHINGLES}))"
    groups = durable(groups.selectExpr("b", "top.root as main", parts.format("n - top.n", "(s - top.s)") + " as rest", parts.format("top.n", "top.s") + " as own"), "groups")
    dealt = placed.join(_small(groups), "b").selectExpr("b", "node", "rest", "own", "if(root = main, rest + pmod(xxhash64(node, 1), own), pmod(xxhash64(node, 1), rest)) as p")
    pairs = dealt.selectExpr("b", "node", "p", "explode(filter(sequence(0L, rest + own - 1L), q -> q != p and least(p, q) < rest)) as q")
    return pairs.selectExpr("xxhash64(b, least(p, q), greatest(p, q)) as b", "node")


def similar_sets(docs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that span the groups which a Jaccard similarity of 0.8 or more makes of the nodes of each bucket."""
    nodes = durable(signatures.groupBy("node").agg(F.min("content").alias("content"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size")), "sets")
    members = nodes.select("node", "size", F.explode("bands").alias("b"))
    sizes = members.groupBy("b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.sum("size").alias("shingles")).where("n > 1")
    parts = F.expr(f"if(shingles > {BUCKET_SHINGLES}, least(n, ceil(2 * shingles / {BUCKET_SHINGLES})), 1L)")
    sizes = durable(sizes.groupBy("n", "h", "shingles").agg(F.min("b").alias("b")).select("b", parts.alias("parts")), "buckets")
    members = durable(members.join(_small(sizes), "b").selectExpr("b", "node", "size", "parts", "pmod(xxhash64(node), parts) as part"), "members")
    texts = durable(nodes.select("node", "content").join(members.select("node").distinct(), "node", "left_semi").select("content"), "compared")
    rows = docs.select(F.xxhash64(text_of()).alias("content"), text_of().alias("text"))
    rows = rows.join(_small(texts), "content", "left_semi").dropDuplicates(["content"])
    sets = durable(rows.mapInArrow(_sets, "node long, own array<int>").dropDuplicates(["node"]), "shingles")
    units = members.selectExpr("if(parts = 1, b, xxhash64(b, part)) as b", "node")
    many = members.where("parts > 1")
    if many.isEmpty():
        return _links(units, sets, "similar")
    chosen = many.groupBy("b", "parts").agg(*[F.min(F.struct(F.xxhash64("node", F.lit(s)).alias("h"), "node", "part")).alias(f"r{s}") for s in range(REPRESENTATIVES)])
    chosen = chosen.select("b", "parts", F.explode(F.array_distinct(F.array(*[F.struct(f"r{s}.node", f"r{s}.part") for s in range(REPRESENTATIVES)]))).alias("r"))
    guests = chosen.selectExpr("b", "r.node", "explode(filter(sequence(0L, parts - 1L), p -> p != r.part)) as part").selectExpr("xxhash64(b, part) as b", "node")
    links = _links(units.unionByName(guests), sets, "similar")
    return links.unionByName(_links(_across(many, links), sets, "similar-across"))


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, of which one stays of each group of near-duplicates, as in
    ``simhash.keep_one``. Links are those of SimHash and, besides, pairs of texts whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more."""
    classes = durable(classes_of(docs), "simhash")
    signatures = docs.select(F.xxhash64(text_of()).alias("content"), text_of().alias("text")).mapInArrow(_signatures, "content long, node long, bands array<long>, size long")
    signatures = durable(signatures, "signatures")
    links = similar_sets(docs, signatures)
    placed = signatures.select("content", "node").distinct().join(classes.select("content", "root").distinct(), "content").select("node", "root").distinct()
    placed = durable(placed, "placed")
    low = durable(placed.groupBy("node").agg(F.min("root").alias("low")), "low")
    edges = placed.join(low, "node").select(F.col("root").alias("u"), F.col("low").alias("v"))
    ends = links.join(low.select(F.col("node").alias("u"), F.col("low").alias("x")), "u").join(low.select(F.col("node").alias("v"), F.col("low").alias("y")), "v")
    merged = durable(components(edges.union(ends.select("x", "y")).where("u != v")).distinct(), "merged")
    classes = classes.join(_small(merged.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left")
    return keep_first(docs, classes.select(F.coalesce("top", "root").alias("root"), "doc_id", "content"))
