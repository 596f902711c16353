"""Word-level removal of long repeats by relative Lempel-Ziv parsing.

The segments that share an anchor (see ``repeats``) form reference blocks. A block is indexed by the order of its suffixes, so
the longest match of any position with another place of the block is found beside it in that order. Every segment is factored
greedily against its block: a factor is the longest match at the current word, with the place of its source, and the parse goes
on behind it; a word met nowhere else is a factor of its own.

All windows inside a factor of at least a window are repeats. A repeated window that lies inside no factor crosses one boundary
and not two: the factor that begins inside it reaches its end or further, being the longest match. So besides long factors only
boundaries between two factors that are a window long together are checked, window by window, against the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Kernel, keyed, merged, repeated_spans, word_symbols

#: Words of an anchor's distinct segments beyond which they are cut to single windows.
GROUP_WORDS = 1 << 17


class ReferenceBlock:
    """Segments laid end to end, with the longest match of each position elsewhere in the block. Matches end with their segment."""

    def __init__(self, segments: list[np.ndarray]):
        sizes = np.array([len(s) for s in segments])
        self.begin = np.cumsum(sizes) - sizes
        self.end = self.begin + sizes
        text = np.concatenate(segments)
        left = np.repeat(self.end, sizes) - np.arange(len(text))  # words up to the end of the segment
        _, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        levels, step = [rank.astype(np.int32)], 1
        while step < sizes.max() and rank.max() < len(rank):
            ahead = np.zeros_like(rank)
            ahead[:-step] = rank[step:]
            ahead[left <= step] = 0
            _, rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            levels.append(rank.astype(np.int32))
            step *= 2
        order = np.argsort(rank, kind="stable")
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):  # greedy steps of halving length give the common prefix
            width = 1 << level
            fits = np.flatnonzero((left[a] - common >= width) & (left[b] - common >= width))
            same = fits[levels[level][a[fits] + common[fits]] == levels[level][b[fits] + common[fits]]]
            common[same] += width
        self.longest = np.zeros(len(text), dtype=np.int64)
        self.source = np.full(len(text), -1, dtype=np.int64)
        self.longest[b], self.source[b] = common, np.where(common > 0, a, -1)
        better = common > self.longest[a]
        self.longest[a[better]], self.source[a[better]] = common[better], b[better]

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, source (-1 for a word met nowhere else) and length of each factor, by start; all segments are parsed in step."""
        at, found = self.begin.copy(), []
        live = np.flatnonzero(at < self.end)
        while len(live):
            p = at[live]
            found.append(p)
            at[live] = p + np.maximum(self.longest[p], 1)
            live = live[at[live] < self.end[live]]
        start = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return start, self.source[start], np.maximum(self.longest[start], 1)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low..high, both ends included; empty where high is less."""
    n = np.maximum(high - low + 1, 0)
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def inside(start: np.ndarray, source: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows inside factors that have a source."""
    met = source >= 0
    return _spread(start[met], start[met] + length[met] - window)


def across(block: ReferenceBlock, start: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Starts of repeated windows that cross a boundary between two factors which are a window long together."""
    same = np.append(np.diff(np.searchsorted(block.begin, start, side="right")) == 0, False) if len(start) else np.zeros(0, dtype=bool)
    i = np.flatnonzero(same)
    i = i[length[i] + length[i + 1] >= window]
    border = start[i + 1]
    asked = _spread(np.maximum(start[i] + 1, border - window + 1), np.minimum(border - 1, border + length[i + 1] - window))
    return asked[block.longest[asked] >= window]


class FactorKernel(Kernel):
    """Which windows of a block's segments of words occur again in it."""

    shard_symbols = 1 << 19

    def __init__(self, window: int, space):
        super().__init__(window, space)
        self.segments: list[np.ndarray] = []

    def add(self, symbols: np.ndarray) -> None:
        self.segments.append(symbols)

    def repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        block = ReferenceBlock(self.segments)
        start, source, length = block.factors()
        hit = np.unique(np.append(inside(start, source, length, self.window), across(block, start, length, self.window)))
        segment = np.searchsorted(block.begin, hit, side="right") - 1
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(segment)) + 1) if len(hit) else ():
            yield int(segment[part[0]]), hit[part] - block.begin[segment[part[0]]]


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeated_words(docs: DataFrame, window: int = 35, gram: int = 8, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row, as in ``SCHEMA``, for every row of ``docs`` (doc_id, text): words covered by a repeated window are removed.

    Null texts have no words. Repeats are judged on the texts as they are and never cross documents; a window that occurs
    twice in one document is a repeat. Repeated rows repeat each other; rows whose doc_id is null take part. Texts of any length
    are cut into pieces of bounded length before they meet others. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, word_symbols, window, gram, FactorKernel, group_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = text.as_py().encode().split()
                runs = merged(found.as_py())
                kept, last = [], 0
                for a, b in runs:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out.append((doc, len(words), sum(b - a for a, b in runs), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, [pa.int64()] * 3 + [pa.string()])], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(run, SCHEMA)
