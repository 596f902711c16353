"""Where windows of fixed length occur again, over all documents: the frame that two operators share.

1. Every text is cut into segments (see ``segments``); a segment is known by its anchor and a hash of its symbols, and is of
   bounded length whatever the text.
2. Equal segments become one class with a count, before they are shuffled: all windows of a class that occurs twice are repeats,
   whatever else there is. Anchors with one class, and whose gram is in its segments once, have nothing to compare.
3. The distinct classes of one anchor are fetched once each and compared by the operator's kernel, many anchors at a time; rows
   come sorted by anchor, so a task holds a few groups and not its whole partition. A group of more than ``GROUP_SYMBOLS``
   symbols is cut further, to its single windows: these are classes themselves, which are counted like those of step 2 and need
   no comparison. So no group of any size meets in one task.
4. Repeated starts go back to all members of their class, and from there to the documents.

Rows are told apart by doc_id and a hash of the text; repeated rows are separate occurrences and so repeat each other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .external import Space
from .segments import cut, gram_hashes
from .shared import durable, give_back, new_path, text_of

#: Symbols of an anchor's distinct segments beyond which they are cut further; bytes of texts that are cut together.
GROUP_SYMBOLS, CUT_BYTES = 1 << 20, 1 << 20

#: The symbols of texts laid end to end, and where each begins, and the end.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


class Kernel:
    """Takes the segments of whole groups, each at least a window long, and tells which of their windows occur again."""

    #: Symbols it is given at a time, but for the rest of the last group.
    shard_symbols = 1 << 20

    def __init__(self, window: int, space: Space):
        self.window, self.space = window, space

    def add(self, symbols: np.ndarray) -> None:
        raise NotImplementedError

    def repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of segments, in the order in which they were added, with starts that are repeated. A segment can come again."""
        raise NotImplementedError


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if len(raw) and raw.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as 64-bit hashes; bytes split at exactly the six white characters."""
    h64 = xxhash.xxh64_intdigest
    words = [[h64(w) for w in t.as_py().encode().split()] for t in texts]
    return np.array([w for ws in words for w in ws], dtype=np.uint64), np.cumsum([0, *map(len, words)])


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending starts as ranges: first ones and ends."""
    gap = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + 1


def keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def _batch(columns: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have about ``most`` bytes, a row at least."""
    sizes = np.cumsum([0, *(len(t.as_buffer()) for t in batch.column(column).cast(pa.binary()))])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _comparable(group: list[tuple[int, int, np.ndarray]], window: int, gram: int) -> list[tuple[int, np.ndarray]]:
    """The segments of one anchor that can share a window with another.

    A window reaches at least half of what it has besides the anchor's gram to one side of it, so its segment has that half in
    common with the other's. Where some segment has the gram more than once, all are kept.
    """
    if any(place < 0 for _, place, _ in group):
        return [(content, s) for content, _, s in group]
    half = -(-(window - gram) // 2)
    sides: list[list] = [[], []]
    for _, place, s in group:
        raw, z = memoryview(s).cast("B"), s.itemsize
        sides[0].append(raw[(place - half) * z : place * z].tobytes() if place >= half else None)
        sides[1].append(raw[(place + gram) * z : (place + gram + half) * z].tobytes() if place + gram + half <= len(s) else None)
    seen = [Counter(x for x in side if x is not None) for side in sides]
    return [(content, s) for (content, _, s), left, right in zip(group, *sides) if seen[0][left] > 1 or seen[1][right] > 1]


def repeated_spans(rows: DataFrame, symbols: Symbols, window: int, gram: int, kernel: type[Kernel], group_symbols: int, memory: int = 64 << 20) -> DataFrame:
    """k1, k2 and spans (an array of a, b: symbols [a, b) are covered by repeated windows) of ``rows`` as ``keyed`` gives them."""
    i64, i32 = pa.int64(), pa.int32()
    spill = new_path(rows.sparkSession, "shards")

    def make_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2, CUT_BYTES):
                s, offsets = symbols(batch.column(2))
                a, b, anchor, place = cut(s, offsets, window, gram)
                doc = np.searchsorted(offsets, a, side="right") - 1
                raw, z = memoryview(s).cast("B"), s.itemsize
                h64 = xxhash.xxh3_64_intdigest
                content = np.array([h64(raw[x:y]) for x, y in zip((a * z).tolist(), ((b - 1 + window) * z).tolist())], dtype=np.uint64).view(np.int64)
                at = offsets[doc] if len(doc) else doc
                yield _batch([batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), (a - at).astype(np.int32), (b - at).astype(np.int32), anchor, content, place.astype(np.int32)], [i64, i64, i32, i32, i64, i64, i32], ["k1", "k2", "a", "b", "anchor", "content", "place"])

    made = durable(rows.select("k1", "k2", "text").mapInArrow(make_segments, "k1 long, k2 long, a int, b int, anchor long, content long, place int"), "segments")
    # written out, so that the joins below are between plain shuffles and adaptive execution can split a hot anchor
    classes = made.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.min(F.struct("k1", "k2", "a", "b")).alias("one"))
    classes = durable(classes, "classes")
    groups = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.min("place").alias("place"), F.sum(F.expr(f"one.b - one.a + {window - 1}")).alias("size"))
    groups = durable(groups.where("m > 1 or place < 0").select("anchor", (F.col("size") > group_symbols).alias("large")), "groups")
    asked = classes.join(groups, "anchor").select("one.*", "anchor", "content", classes.place, "large")
    wanted = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "anchor", "content", "place", "large")).alias("parts"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 0, CUT_BYTES):
                s, offsets = symbols(batch.column(0))
                raw, z = memoryview(s).cast("B"), s.itemsize
                parts = batch.column(1)
                doc = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
                a, b, anchor, content, place, large = parts.flatten().flatten()
                first, end = (offsets[doc] + a.to_numpy()) * z, (offsets[doc] + b.to_numpy() - 1 + window) * z
                for at in range(0, len(doc), 2048):
                    to = min(at + 2048, len(doc))
                    held = pa.array([raw[x:y] for x, y in zip(first[at:to].tolist(), end[at:to].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([anchor[at:to], content[at:to], place[at:to], large[at:to], held], names=["anchor", "content", "place", "large", "symbols"])

    fetched = durable(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "parts").mapInArrow(fetch, "anchor long, content long, place int, large boolean, symbols binary"), "contents")
    kind = symbols(pa.array([], pa.string()))[0].dtype

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(spill, memory)
        held: list[tuple[int, int]] = []
        group: list[tuple[int, int, np.ndarray]] = []  # content, place of the anchor, symbols
        own, size, last = kernel(window, space), 0, None

        def results() -> Iterator[pa.RecordBatch]:
            out: list[list] = [[], [], [], []]
            for k, starts in own.repeats():
                x, y = _runs(starts)
                for column, values in zip(out, ([held[k][0]] * len(x), [held[k][1]] * len(x), x.tolist(), y.tolist())):
                    column += values
                if len(out[0]) > 10_000:
                    yield _batch(out, [i64, i64, i32, i32], ["anchor", "content", "x", "y"])
                    out = [[], [], [], []]
            yield _batch(out, [i64, i64, i32, i32], ["anchor", "content", "x", "y"])

        def close_group() -> None:
            nonlocal size
            for content, s in _comparable(group, window, gram):
                own.add(s)
                held.append((last[0], content))
                size += len(s)
            group.clear()

        try:
            for batch in batches:
                for anchor, content, place, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                    if last == (anchor, content):
                        continue  # a repeated row brought its class along again
                    if last is not None and last[0] != anchor:
                        close_group()
                        if size >= own.shard_symbols:
                            yield from results()
                            held, own, size = [], kernel(window, space), 0
                    last = (anchor, content)
                    group.append((content, place, np.frombuffer(raw.as_buffer(), dtype=kind)))
            if group:
                close_group()
            if held:
                yield from results()
        finally:
            space.close()
        give_back()

    near = fetched.where("not large").select("anchor", "content", "place", "symbols").repartition("anchor").sortWithinPartitions("anchor", "content")
    partial = near.mapInArrow(compare, "anchor long, content long, x int, y int")

    def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw, z = memoryview(raw.as_buffer()), kind.itemsize
                n = len(raw) // z - window + 1
                h = [xxhash.xxh3_128_digest(raw[i * z : (i + window) * z]) for i in range(n)]
                yield _batch([[anchor] * n, [content] * n, range(n), h], [i64, i64, i32, pa.binary()], ["anchor", "content", "x", "h"])

    single = fetched.where("large").select("anchor", "content", "symbols").dropDuplicates(["anchor", "content"]).mapInArrow(single_windows, "anchor long, content long, x int, h binary")
    single = durable(single, "windows")
    twice = durable(single.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-windows")
    counted = single.join(twice, "h", "left_semi").select("anchor", "content", "x", (F.col("x") + 1).alias("y"))
    whole = classes.where("n > 1").select("anchor", "content", F.lit(0).alias("x"), (F.col("one.b") - F.col("one.a")).alias("y"))
    ranges = whole.unionByName(partial).unionByName(counted)
    spans = made.join(ranges, ["anchor", "content"]).select("k1", "k2", (F.col("a") + F.col("x")).alias("a"), (F.col("a") + F.col("y") - 1 + window).alias("b"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
