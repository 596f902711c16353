"""Byte-level removal of long repeats through suffix sorting by external induction.

The segments that share an anchor (see ``repeats``) form shards, whose suffixes are sorted by recursive induction. The starts of
rising runs (S* positions) are brought in order; every other suffix follows from its successor: a falling suffix is reached from
its smaller successor while a priority queue is read upwards, a rising one from its larger successor while one is read
downwards. What the queue carries is a tuple per suffix: its position, the symbols before it, so that the text is not asked at
each step, and the length of the prefix it shares with the suffix before it under its first symbol. That length is one more than
the least of the lengths between the two successors, which a running minimum by last push gives.

S* positions are ordered the same way: a first induction from unordered S* positions sorts the pieces between them, equal pieces
get equal names, and the sequence of names is sorted by recursion, as far as a window reaches. Names that fit in memory are
sorted by doubling, which ends the recursion.

Text, names and queues move to files beyond the shard's share of memory (see ``external``); nothing but minima by symbol and
the names at the end of the recursion must fit. Neighbours in the final order whose common prefix reaches the window are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .external import BucketQueue, Space, Tape
from .repeats import GROUP_SYMBOLS, Kernel, byte_symbols, keyed, merged, repeated_spans

_SEPARATOR = 1  # symbols: 0 ends the shard, 1 ends a segment, bytes follow
#: Bytes of memory for each name that is sorted without further recursion.
_NAME_BYTES = 48

Batch = tuple[np.ndarray, np.ndarray]  # positions in descending order of suffixes, lengths of the prefix shared with the one before


def range_minima(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low..high], both ends included, for each pair."""
    if not len(low):
        return np.zeros(0, dtype=x.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=x.dtype)
    table = x
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
    return out


class Minima:
    """Of a stream of lengths of at most ``most``: the least since a symbol was last pushed."""

    def __init__(self, symbols: int, most: int):
        self.most, self.n = most, 0
        self.last = np.full(symbols, -1, dtype=np.int64)  # place of the last push by symbol
        self.below = np.full(most + 1, -1, dtype=np.int64)  # the last place of a length of at most this

    def push(self, lengths: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pushes at ascending places ``at`` of a batch: their order by symbol, and the least length since the symbol's last push."""
        order = np.argsort(symbols, kind="stable")
        s, i = symbols[order], at[order]
        out = np.empty(len(s), dtype=lengths.dtype)
        if len(s):
            first = np.append(True, s[1:] != s[:-1])
            again = np.flatnonzero(~first)
            out[again] = range_minima(lengths, i[again - 1] + 1, i[again])
            head = np.flatnonzero(first)
            older = np.searchsorted(self.below, self.last[s[head]] + 1)
            out[head] = np.minimum(np.minimum(older, self.most), np.minimum.accumulate(lengths)[i[head]])
            tail = np.append(head[1:], len(s)) - 1
            self.last[s[tail]] = self.n + i[tail]
        seen = np.full(self.most + 1, -1, dtype=np.int64)
        seen[lengths] = self.n + np.arange(len(lengths))
        np.maximum(self.below, np.maximum.accumulate(seen), out=self.below)
        self.n += len(lengths)
        return order, out


class Sorter:
    """Orders the suffixes of a tape of symbols below ``symbols``, whose last is 0 and the only one, as far as ``reach`` symbols decide."""

    def __init__(self, text: Tape, symbols: int, reach: int, space: Space):
        self.text, self.n, self.symbols, self.reach, self.space = text, text.n, symbols, reach, space
        self.width = max(1, (symbols - 1).bit_length())
        self.carried = 63 // self.width

    def before(self, at: np.ndarray) -> np.ndarray:
        """The symbols before each position, the nearest lowest, under a bit that marks the end."""
        out = np.ones(len(at), dtype=np.uint64)
        for k in range(self.carried, 0, -1):
            there = np.flatnonzero(at >= k)
            out[there] = (out[there] << np.uint64(self.width)) | self.text.gather(at[there] - k).astype(np.uint64)
        return out

    def common(self, p: np.ndarray, q: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many symbols two suffixes share, at most ``reach``, where ``known`` are."""
        known = np.minimum(known, self.reach)
        open_ = np.flatnonzero(known < self.reach)
        while len(open_):
            same = self.text.gather(p[open_] + known[open_]) == self.text.gather(q[open_] + known[open_])
            open_ = open_[same]
            known[open_] += 1
            open_ = open_[known[open_] < self.reach]
        return known

    def stars(self) -> Tape:
        """S* positions in the order of the text, the last symbol among them."""
        found, queue = Tape(self.space, "i8"), BucketQueue(self.space)
        end, after, rises = self.n, -1, True  # the symbol after the block and whether its suffix rises
        while end > 0:
            start = max(0, end - self.space.chunk)
            x = self.text.read(max(0, start - 1), end).astype(np.int64)
            own = x[1:] if start else x
            change = np.append(np.flatnonzero(own[1:] != own[:-1]), len(own) - 1)
            ahead = np.append(own[change[:-1] + 1], after)
            up = ahead > own[change]
            up[-1] = True if end == self.n else (rises if after == own[-1] else after > own[-1])
            up = np.repeat(up, np.diff(np.append(-1, change)))
            falls = x[:-1] > x[1:]  # the symbol before a rising position is greater: its suffix falls
            star = np.flatnonzero(up[-len(falls) :] & falls) + (start if start else 1) if len(falls) else np.zeros(0, dtype=np.int64)
            queue.push(np.zeros(len(star), dtype=np.int64), star.astype(np.int64)[::-1])
            end, after, rises = start, own[0], bool(up[0])
        while (rows := queue.take(0, last=True)) is not None:
            found.append(rows[0][::-1])
        return found.finish()

    def induce(self, seeds: BucketQueue, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All suffixes from ordered ``seeds`` (S* positions by first symbol): positions, shared lengths and whether a position is
        S*, in descending order. Not ``exact``: lengths are 1 or 0, whether the pieces through the next S* are equal."""
        most = self.reach if exact else 1
        mask = np.uint64((1 << self.width) - 1)
        queue, falling = BucketQueue(self.space), BucketQueue(self.space, down=True)

        def send(minima: Minima, at: np.ndarray, before: np.ndarray, shared: np.ndarray, go: np.ndarray) -> None:
            place = np.flatnonzero(go)
            sym = (before[place] & mask).astype(np.int64)
            order, least = minima.push(shared, place, sym)
            place = place[order]
            rest = before[place] >> np.uint64(self.width)
            nxt = at[place] - 1
            empty = np.flatnonzero((rest == 1) & (nxt > 0))
            rest[empty] = self.before(nxt[empty])
            queue.push(sym[order], nxt, rest, np.minimum(least + 1, most).astype(np.uint16) if exact else least)

        def border(p: int, q: int) -> int:
            return int(self.common(np.array([p]), np.array([q]), np.array([1]))[0]) if exact else 0

        minima = Minima(self.symbols, most)
        for c in _keys(queue, seeds):
            lowest = None
            while (rows := queue.take(c)) is not None:
                at, before, shared = rows[0], rows[1], rows[2].copy()
                if lowest is None:
                    shared[0] = 0
                lowest = int(at[-1])
                falling.push(np.full(len(at), c), at, before, shared)
                send(minima, at, before, shared, (at > 0) & ((before & mask) >= np.uint64(c)))
            begun = False
            while (rows := seeds.take(c, last=True)) is not None:
                at, before, shared = (x[::-1].copy() for x in rows)
                if not begun:
                    shared[0] = 0 if lowest is None else border(lowest, int(at[0]))
                    begun = True
                send(minima, at, before, shared, at > 0)
        queue, minima = BucketQueue(self.space, down=True), Minima(self.symbols, most)
        for c in _keys(queue, falling):
            last = None
            while (rows := queue.take(c)) is not None:
                at, before, shared = rows[0], rows[1], rows[2].copy()
                if last is None:
                    shared[0] = 0
                last = int(at[-1])
                yield at, shared, (at > 0) & ((before & mask) > np.uint64(c))
                send(minima, at, before, shared, (at > 0) & ((before & mask) <= np.uint64(c)))
            below = None
            while (rows := falling.take(c, last=True)) is not None:
                at, before, own = (x[::-1] for x in rows)
                if below is None:
                    below = 0 if last is None else border(last, int(at[0]))
                shared = np.append(np.uint16(below), own[:-1])
                below = int(own[-1])
                yield at, shared, np.zeros(len(at), dtype=bool)
                send(minima, at, before, shared, (at > 0) & ((before & mask) < np.uint64(c)))
        yield np.array([self.n - 1]), np.zeros(1, dtype=np.uint16), np.ones(1, dtype=bool)

    def order(self) -> Iterator[Batch]:
        """All suffixes in descending order."""
        stars = self.stars()
        seeds = BucketQueue(self.space)
        for a in range(0, stars.n, self.space.chunk):
            at = stars.read(a, a + self.space.chunk)
            self._seed(seeds, at, np.ones(len(at), dtype=np.uint16))
        names, count = self._names(self.induce(seeds, False), stars.n)
        if stars.n * _NAME_BYTES <= self.space.memory:
            ranked = order_names(names.read(0, names.n), self.reach // 2 + 2, self.space.chunk)
        else:
            ranked = Sorter(names, count, self.reach // 2 + 2, self.space).order()
        seeds = BucketQueue(self.space)
        held: np.ndarray | None = None
        for index, shared in ranked:
            at = stars.gather(index)
            past = stars.gather(np.minimum(index + shared, stars.n - 1)) - at  # symbols of the equal names
            upper = at[:-1] if held is None else np.append(held, at[:-1])
            lower, past = (at[1:], past[1:]) if held is None else (at, past)
            # a length belongs to the greater of two neighbours
            self._seed(seeds, upper, self.common(upper, lower, past).astype(np.uint16))
            held = at[-1:]
        self._seed(seeds, held, np.zeros(1, dtype=np.uint16))
        names.drop()
        stars.drop()
        for at, shared, _ in self.induce(seeds, True):
            yield at, shared

    def _seed(self, seeds: BucketQueue, at: np.ndarray, shared: np.ndarray) -> None:
        sym = self.text.gather(at).astype(np.int64)
        by = np.argsort(sym, kind="stable")
        seeds.push(sym[by], at[by], self.before(at[by]), shared[by])

    def _names(self, sorted_: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], stars: int) -> tuple[Tape, int]:
        """The names of the S* pieces in the order of the text, and how many there are."""
        placed = BucketQueue(self.space)
        width = self.n // max(1, -(-stars // self.space.chunk)) + 1
        name, least = -1, 1
        for at, shared, star in sorted_:
            i = np.flatnonzero(star)
            if len(i):
                equal = np.minimum.reduceat(shared[: i[-1] + 1], np.append(0, i[:-1] + 1))
                equal[0] = min(equal[0], least)
                own = name + np.cumsum(equal == 0)
                name = int(own[-1])
                part = at[i] // width
                by = np.argsort(part, kind="stable")
                placed.push(part[by], at[i][by], own[by])
                least = int(shared[i[-1] + 1 :].min(initial=1))
            else:
                least = min(least, int(shared.min(initial=1)))
        names = Tape(self.space, "i4")
        while (k := placed.next()) is not None:
            parts = []
            while (rows := placed.take(k)) is not None:
                parts.append(rows)
            at, own = map(np.concatenate, zip(*parts))
            names.append(name - own[np.argsort(at)])
        return names.finish(), name + 1


def _keys(*queues: BucketQueue) -> Iterator[int]:
    """The keys of queues that are read the same way, those that come meanwhile among them, until all are empty."""
    while ahead := [k * q.sign for q in queues if (k := q.next()) is not None]:
        yield queues[0].sign * min(ahead)


def order_names(names: np.ndarray, reach: int, chunk: int) -> Iterator[Batch]:
    """Suffixes of a sequence of names in descending order, as far as ``reach`` names decide, by doubling."""
    rank, step = names.astype(np.int64), 1
    levels = [names]
    while step < reach and rank.max() < len(rank) - 1:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] + 1
        key = rank * (len(rank) + 2) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        levels.append(rank.astype(np.int32))
        step *= 2
    order = np.argsort(rank, kind="stable")[::-1]
    for at in range(0, len(order), chunk):
        a = order[at : at + chunk]
        b = order[at - 1 : at - 1 + len(a)] if at else np.append(a[:1], a[:-1])
        shared = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i, j = a + shared, b + shared
            inside = np.flatnonzero(np.maximum(i, j) < len(order))
            same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
            shared[same] += 1 << k
        if not at:
            shared[0] = 0
        yield a, np.minimum(shared, reach)


class SuffixKernel(Kernel):
    """Which windows of a shard's byte segments occur again in it."""

    def __init__(self, window: int, space: Space):
        super().__init__(window, space)
        self.text = Tape(space, "u2")
        self.begin: list[int] = []

    def add(self, symbols: np.ndarray) -> None:
        self.begin.append(self.text.n)
        self.text.append(np.append(symbols.astype(np.uint16) + np.uint16(2), np.uint16(_SEPARATOR)))

    def repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        self.text.append(np.zeros(1, dtype=np.uint16))
        self.text.finish()
        n, hits = self.text.n, BucketQueue(self.space)
        width = max(1, self.space.chunk)
        before = np.zeros(0, dtype=np.int64)
        for at, shared in Sorter(self.text, 258, self.window, self.space).order():
            line = np.append(before, at)
            same = np.flatnonzero(shared[-len(line) + 1 :] >= self.window) if len(line) > 1 else np.zeros(0, dtype=np.int64)
            found = np.unique(np.append(line[same], line[same + 1])) if len(same) else same
            hits.push(found // width, found)
            before = line[-1:]
        self.text.drop()
        begin = np.array([*self.begin, n - 1, n], dtype=np.int64)
        while (k := hits.next()) is not None:
            parts = []
            while (rows := hits.take(k)) is not None:
                parts.append(rows[0])
            place = np.unique(np.concatenate(parts))
            segment = np.searchsorted(begin, place, side="right") - 1
            whole = place + self.window < begin[segment + 1]  # equal windows across the end of a segment are none
            place, segment = place[whole], segment[whole]
            for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(segment)) + 1) if len(place) else ():
                yield int(segment[part[0]]), place[part] - begin[segment[part[0]]]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeated_bytes(docs: DataFrame, window: int = 400, gram: int = 32, group_symbols: int = GROUP_SYMBOLS, memory: int = 64 << 20) -> DataFrame:
    """One row, as in ``SCHEMA``, for every row of ``docs`` (doc_id, text): bytes covered by a repeated window are removed.

    Null texts count as empty. Repeats are judged on the texts as they are and never cross documents; a window that occurs
    twice in one document is a repeat. Repeated rows repeat each other; rows whose doc_id is null take part. Texts of any length
    are cut into pieces of bounded length before they meet others. Other columns of ``docs`` are not read, whatever their names.
    ``memory`` is what a shard holds before it writes to the shared folder.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, byte_symbols, window, gram, SuffixKernel, group_symbols, memory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                runs = merged(found.as_py())
                kept, last = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[last:a])
                    last = b
                kept.update(raw[last:])
                out.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, [pa.int64()] * 4 + [pa.string()])], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(run, SCHEMA)
