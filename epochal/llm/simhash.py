"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Equal fingerprints are one node
from the start, so copies cost nothing later. Two fingerprints that differ in at most three of 64 bits agree on one of four
16-bit blocks; for each block the fingerprints, turned so that this block leads, form tries below its 65,536 values. Each trie
is joined with itself: pairs of its nodes are followed down together, the bits in which they differ are counted, and a pair
ends as soon as the count exceeds the budget. All tries of a partition are followed at once with arrays, a bounded number of
node pairs at a time.

A trie that holds far more fingerprints than others is split: its subtrees a few bits further down are paired, and each pair
that is still within the budget becomes a unit of work of its own, so no task holds a hot trie whole and no link is lost.
Each unit emits a spanning forest of its links and not every pair; components follow from all forests together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import durable, text_of, unused, without

BITS, BLOCK, BUDGET = 64, 16, 3
#: Node pairs followed at a time; rows of one unit of work at most, before it is split. A trie is split at most 14 bits down, where
#: a fingerprint is in 1 + 14 + 91 + 364 units; its units reach this many rows only beyond 6.5e9 distinct fingerprints in one trie.
FRONTIER, UNIT_ROWS = 200_000, 400_000


def fingerprint(text: str, shingle: int = 3) -> int:
    """Of a text lower-cased in A-Z: majority bits of the XXH64 (seed 42) of its word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes split at exactly the six white characters and lower only A-Z
    if not words:
        return 0
    spans = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)))
    join, h64 = b" ".join, xxhash.xxh64_intdigest
    hashes = np.array([h64(join(s), 42) for s in spans], dtype=">u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a signed long) and a hash of the text of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fingerprint", "content"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("content"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long, content long")


def _units(nodes: DataFrame) -> DataFrame:
    """Each fingerprint once per block and unit of work: unit, side, turned."""
    turned = "(shiftleft(fingerprint, 16 * t) | shiftrightunsigned(fingerprint, 64 - 16 * t))"
    rows = nodes.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(BITS // BLOCK - 1))).alias("t"))
    rows = rows.select("t", F.expr(f"if(t = 0, fingerprint, {turned})").alias("turned"))
    rows = rows.withColumn("root", F.expr(f"(t << {BLOCK}) | cast(shiftrightunsigned(turned, {BITS - BLOCK}) as int)"))
    sizes = durable(rows.groupBy("root").count(), "tries")  # at most 4 * 65,536 rows
    total = sizes.agg(F.sum("count")).first()[0] or 0
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(UNIT_ROWS, max(1024, 2 * total // parts))
    hot = sizes.where(F.col("count") > most).selectExpr("root", f"least(14, cast(ceil(log2(count / {most})) as int) + 1) as bits")
    rows = rows.join(F.broadcast(hot), "root", "left").selectExpr("cast(root as long) as root", "turned", "coalesce(bits, 0) as bits")
    near = f"filter(sequence(0, cast(shiftleft(1, bits) as int) - 1), x -> bit_count(x) <= {BUDGET})"
    own = f"cast(shiftrightunsigned(turned, {BITS - BLOCK} - bits) & (shiftleft(1, bits) - 1) as int)"
    rows = rows.selectExpr("root", "turned", f"{own} as own", f"explode({near}) as x").selectExpr("root", "turned", "own", "own ^ x as other")
    return rows.selectExpr("(root << 28) | (least(own, other) << 14) | greatest(own, other) as unit", "if(own <= other, 0, 1) as side", "turned")


class _Forest:
    """Which rows are linked, as labels that name the least row of each set."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def join_tries(turned: np.ndarray, unit: np.ndarray, side: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of linked rows. The rows are sorted by unit, side and turned fingerprint; fingerprints of a unit are distinct."""
    n = len(turned)
    forest = _Forest(n)
    edge = np.flatnonzero(np.diff(unit)) + 1
    starts, ends = np.append(0, edge), np.append(edge, n)
    right = starts + np.add.reduceat((side == 0).astype(np.int64), starts)  # where side 1 begins
    alone = right == ends
    b0, b1 = np.where(alone, starts, right), ends
    a0, a1 = starts, np.where(alone, ends, right)
    zeros: dict[int, np.ndarray] = {}
    block = (unit >> 44).astype(np.int64)
    stack = [(BITS - BLOCK - 1, a0, a1, b0, b1, np.zeros(len(starts), dtype=np.int8))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append((bit, *(x[half:] for x in (a0, a1, b0, b1, err))))
            a0, a1, b0, b1, err = (x[:half] for x in (a0, a1, b0, b1, err))
            stack.append((bit, a0, a1, b0, b1, err))
            continue
        same = a0 == b0
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single & ~same], b0[single & ~same]
            diff = turned[i] ^ turned[j]
            good = np.bitwise_count(diff) <= budget
            for t in range(1, BITS // BLOCK):  # a pair counts only for the first block on which it agrees
                for u in range(t):
                    shift = np.uint64(BITS - BLOCK - BLOCK * ((u - t) % (BITS // BLOCK)))
                    good &= (block[i] != t) | (((diff >> shift) & np.uint64(0xFFFF)) != 0)
            forest.link(i[good], j[good])
        # nodes that are linked as a whole have nothing left to find
        change = np.append(0, np.cumsum(forest.label[1:] != forest.label[:-1])) if len(a0) else np.zeros(1, dtype=np.int64)
        done = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (forest.label[a0] == forest.label[b0]) if len(a0) else single
        keep = ~single & ~(done & ((a1 - a0 > 1) | ~same))
        a0, a1, b0, b1, err, same = (x[keep] for x in (a0, a1, b0, b1, err, same))
        if not len(a0):
            continue
        if bit not in zeros:
            zeros[bit] = np.append(0, np.cumsum((turned >> np.uint64(bit)) & np.uint64(1) == 0)).astype(np.int64)
        z = zeros[bit]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), *([] if same.all() else [tuple(x[~same] for x in (am, a1, b0, bm, err + 1))])]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts))
        keep = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        stack.append((bit - 1, *(x[keep] for x in (a0, a1, b0, b1, err))))
    return forest.label


def _turn_back(turned: np.ndarray, unit: np.ndarray) -> np.ndarray:
    by = (unit >> 44).astype(np.uint64) * np.uint64(BLOCK)
    back = np.where(by == 0, turned, (turned >> by) | (turned << (np.uint64(BITS) - np.maximum(by, np.uint64(1)))))
    return back.view(np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of whole units, from rows that come sorted by unit."""
    held: list[list[np.ndarray]] = []

    def flush(rows: list[list[np.ndarray]], last: bool) -> tuple[pa.RecordBatch | None, list[list[np.ndarray]]]:
        unit, side, turned = (np.concatenate(c) for c in zip(*rows))
        cut = len(unit) if last else int(np.flatnonzero(np.diff(unit))[-1]) + 1 if unit[0] != unit[-1] else 0
        rest = [[unit[cut:], side[cut:], turned[cut:]]] if cut < len(unit) else []
        if not cut:
            return None, rest
        unit, side, turned = unit[:cut], side[:cut], turned[:cut].view(np.uint64)
        label = join_tries(turned, unit, side)
        own = _turn_back(turned, unit)
        linked = label != np.arange(cut)
        return pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], names=["u", "v"]), rest

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if sum(len(x[0]) for x in held) >= UNIT_ROWS // 2:
            out, held = flush(held, False)
            if out is not None:
                yield out
    if held:
        out, _ = flush(held, True)
        if out is not None:
            yield out


def classes_of(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, content, root and component_id for every row of ``docs`` (doc_id, text)."""
    own = durable(fingerprints(docs, shingle), "fingerprints")
    nodes = durable(own.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "nodes")
    units = _units(nodes).repartition("unit").sortWithinPartitions("unit", "side", "turned")
    roots = components(units.mapInArrow(_links, "u long, v long"))
    placed = roots.join(nodes, roots.node == nodes.fingerprint).select("fingerprint", "root", "low")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = placed.join(lowest, "root").select("fingerprint", "root", "component_id")
    every = nodes.join(linked, "fingerprint", "left")
    every = every.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    # written out, so that the join is between two plain shuffles and adaptive execution can split a hot fingerprint
    return own.join(durable(every, "classes"), "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of ``docs`` (doc_id, text).

    ``component_id`` is the least doc_id that links of at most three differing bits reach. Null and empty texts have the zero
    fingerprint and link like any other. Repeated rows are returned each; rows whose doc_id is null take part.
    """
    return classes_of(docs, shingle).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, of which one stays of each group of near-duplicates:
    that with the least doc_id (null last), then the least hash of its text. Of repeated rows one stays."""
    return keep_first(docs, classes_of(docs, shingle))


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each root of ``classes`` (root, doc_id, content) the first row of ``docs``, as ``keep_one`` orders them."""
    key = unused(docs, "id", "content")
    rows = docs.withColumns({key[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), key[1]: F.xxhash64(text_of())})
    classes = classes.select("root", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias(key[0]), F.col("content").alias(key[1]))
    counted = durable(classes.groupBy("root", *key).agg(F.count("*").alias("n")), "copies")
    first = durable(counted.groupBy("root").agg(F.min(F.struct(*key)).alias("one")).select("root", "one.*"), "first")
    gone = counted.join(first, ["root", *key], "left_anti")
    kept = without(rows, gone, key)
    doubled = counted.join(first, ["root", *key], "left_semi").where("n > 1").select(*key)
    if not doubled.isEmpty():
        again = kept.join(doubled, key, "left_semi").dropDuplicates(key)
        kept = without(kept, doubled, key).unionByName(again)
    return kept.select(*docs.columns)
