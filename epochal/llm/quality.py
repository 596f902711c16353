"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is a linear function of features of the line and of its neighbours, neighbouring labels
are tied by transition weights, and forward and backward passes give each line's chance to be good. A document's score is the
mean of those chances, weighted by the lines' lengths, brought to a calibrated scale by one logistic step.

The field is trained on a bounded sample of labelled documents (``max_documents``, cut into pieces of at most ``PIECE`` lines),
whose lines all take the document's label. Scoring reads every line of every text. Features come from bytes alone.

Null and empty texts are one line of no length. Where no labels can be learnt from, every score is the share of good labels, or
one half where there are none. Repeated rows are scored each, labels that contradict each other are both learnt from, and texts of
any length are scored whole. Other columns are kept or not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, text_of, unused

#: Lines of a piece of training text; bytes of text whose features are made at once.
PIECE, SLICE_BYTES = 64, 1 << 19

_OTHER, _UPPER, _LOWER, _DIGIT, _WHITE, _BANG, _PIPE, _SYMBOL, _END = range(9)


def _classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.uint8)
    for chars, k in ((bytes(range(65, 91)), _UPPER), (bytes(range(97, 123)), _LOWER), (b"0123456789", _DIGIT), (b" \t\n\x0b\x0c\r", _WHITE), (b"!", _BANG), (b"|", _PIPE), (b"#*$%&<>=_~^@{}[]\\", _SYMBOL), (b".?;:", _END)):
        kind[list(chars)] = k
    return kind


_CLASS = _classes()
_POWERS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
FEATURES = ("bias", "length", "upper", "bangs", "symbols", "pipes", "digits", "repeats", "repeats_2", "seen_line", "word_length", "ends", "short", "title")
#: Those that are also taken from the line before and the line after.
_NEAR = (2, 3, 4, 5, 7, 8, 9)
N_FEATURES = len(FEATURES) + 2 * len(_NEAR)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: document of each line, length in bytes, and features. Every text has one line at least."""
    n_docs, base = len(offsets) - 1, offsets[0]
    data, offsets = data[base : offsets[-1]], (offsets - base).astype(np.int64)
    cut = np.flatnonzero(data == 10)
    cut_doc = np.searchsorted(offsets, cut, side="right") - 1
    docs = np.arange(n_docs)
    first = np.concatenate([offsets[:-1], cut + 1])
    order = np.lexsort((first, np.concatenate([docs, cut_doc])))
    start, doc = first[order], np.concatenate([docs, cut_doc])[order]
    last = np.concatenate([cut, offsets[1:]])
    end = last[np.lexsort((last, np.concatenate([cut_doc, docs])))]
    size = end - start
    kind = _CLASS[data]
    if len(data) > 1:  # capital letters of the Latin-1 block
        kind[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = _UPPER
        kind[1:][(data[:-1] == 0xC3) & (data[1:] > 0x9E)] = _LOWER

    def per_line(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, dtype=np.int64)
        np.cumsum(flag, out=total[1:])
        return total[end] - total[start]

    counts = {k: per_line(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _BANG, _PIPE, _SYMBOL)}
    solid = kind != _WHITE
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = start[(start > 0) & (start < len(data))]
    begins[edges] = solid[edges]  # texts lie end to end without white space between them
    word_at = np.flatnonzero(begins)
    n_words = per_line(begins)
    safe = np.maximum(n_words, 1)
    repeats = repeats_2 = title = np.zeros(len(start), dtype=np.int64)
    line_hash = np.zeros(len(start), dtype=np.uint64)
    if len(word_at):
        place = np.arange(len(data)) - np.repeat(np.append(0, word_at), np.diff(np.concatenate([[0], word_at, [len(data)]])))
        mixed = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], np.uint64(0))
        word = np.add.reduceat(mixed, word_at)
        word_line = np.searchsorted(start, word_at, side="right") - 1

        def lag(k: int) -> np.ndarray:
            same = np.zeros(len(word), dtype=bool)
            same[k:] = (word[k:] == word[:-k]) & (word_line[k:] == word_line[:-k]) if len(word) > k else False
            return np.bincount(word_line, same, len(start)).astype(np.int64)

        repeats, repeats_2 = lag(1), lag(2)
        title = np.bincount(word_line, kind[word_at] == _UPPER, len(start)).astype(np.int64)
        rank = np.arange(len(word)) - np.repeat(np.append(0, np.flatnonzero(np.diff(word_line)) + 1), np.diff(np.concatenate([[0], np.flatnonzero(np.diff(word_line)) + 1, [len(word)]])))
        np.add.at(line_hash, word_line, word * _POWERS[rank & 63])
    key = line_hash ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    seen = (times[inverse] > 1) & (n_words > 0)
    letters = np.maximum(counts[_UPPER] + counts[_LOWER], 1)
    final = np.where(size > 0, kind[np.clip(end - 1, 0, max(len(data) - 1, 0))] if len(data) else 0, 0)
    own = np.stack(
        [
            np.ones(len(start)),
            np.log1p(size) / 8,
            counts[_UPPER] / letters,
            np.minimum(counts[_BANG] / safe, 2),
            np.minimum(counts[_SYMBOL] / safe, 3),
            np.minimum(counts[_PIPE] / safe, 2),
            counts[_DIGIT] / np.maximum(size, 1),
            repeats / safe,
            repeats_2 / safe,
            seen,
            np.minimum(size / safe, 20) / 10,
            final == _END,
            n_words < 4,
            title / safe,
        ],
        axis=1,
    ).astype(np.float32)
    near = own[:, _NEAR]
    before, after = np.zeros_like(near), np.zeros_like(near)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = near[:-1][joined]
    after[:-1][joined] = near[1:][joined]
    return doc, size, np.concatenate([own, before, after], axis=1)


def _padded(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One row per document, as long as the longest, from values that follow each other."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((len(counts), counts.max()), dtype=values.dtype)
    out[np.repeat(np.arange(len(counts)), counts), place] = values
    return out


def marginals(evidence: np.ndarray, counts: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains padded to one width, the longest first: chance of good per line, expected pairs, log of the normaliser.

    ``evidence`` is the log odds of good before neighbours are heard; ``ties[a, b]`` is the weight of label b after label a.
    """
    n, width = evidence.shape
    fore = np.zeros((width, n, 2))
    fore[0, :, 1] = evidence[:, 0]
    active = [int(np.searchsorted(-counts, -t, side="left")) for t in range(width)]  # chains with more than t lines
    for t in range(1, width):
        k = active[t]
        step = np.logaddexp(fore[t - 1, :k, 0, None] + ties[0], fore[t - 1, :k, 1, None] + ties[1])
        step[:, 1] += evidence[:k, t]
        fore[t, :k] = step
    back = np.zeros((width, n, 2))
    for t in range(width - 2, -1, -1):
        k = active[t + 1]
        ahead = back[t + 1, :k].copy()
        ahead[:, 1] += evidence[:k, t + 1]
        back[t, :k] = np.logaddexp(ties[:, 0] + ahead[:, :1], ties[:, 1] + ahead[:, 1:])
    last = fore[counts - 1, np.arange(n)]
    total = np.logaddexp(last[:, 0], last[:, 1])
    good = np.exp(np.minimum(fore[:, :, 1] + back[:, :, 1] - total, 0)).T
    pairs = np.zeros((2, 2))
    for t in range(1, width):
        k = active[t]
        for a in (0, 1):
            for b in (0, 1):
                w = fore[t - 1, :k, a] + ties[a, b] + (evidence[:k, t] if b else 0) + back[t, :k, b] - total[:k]
                pairs[a, b] += np.exp(np.minimum(w, 0)).sum()
    return good, pairs, total


@dataclass
class Field:
    """Trained weights, and the logistic step from the mean chance to the score."""

    weights: np.ndarray
    ties: np.ndarray
    slope: float = 0.0
    shift: float = 0.0

    def means(self, counts: np.ndarray, sizes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Length-weighted mean chance of good for documents whose lines follow each other."""
        evidence = features @ self.weights
        out = np.empty(len(counts))
        order = np.argsort(-counts, kind="stable")
        first = np.cumsum(counts) - counts
        at = 0
        while at < len(order):  # documents of like length together, so padding stays small
            width = counts[order[at]]
            n = max(1, min(len(order) - at, (1 << 16) // width))
            some = order[at : at + n]
            rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in some])
            good, _, _ = marginals(_padded(counts[some], evidence[rows].astype(np.float64)), counts[some], self.ties)
            weight = _padded(counts[some], sizes[rows] + 1.0)
            out[at : at + n] = (good * weight).sum(axis=1) / weight.sum(axis=1)
            at += n
        result = np.empty(len(counts))
        result[order] = out
        return result

    def scores(self, means: np.ndarray) -> np.ndarray:
        p = np.clip(means, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def _calibrate(means: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on the log odds of the mean, by Newton steps with a little shrinkage."""
    p = np.clip(means, 1e-4, 1 - 1e-4)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (labels - q) - 0.1 * (w - [1, 0])
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2), grad)
    return max(float(w[0]), 0.05), float(w[1])


def train(pieces: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 150) -> Field:
    """A field from (label, line sizes, features) per piece of text."""
    labels = np.array([p[0] for p in pieces], dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    order = np.argsort([-len(p[1]) for p in pieces], kind="stable")
    pieces, labels = [pieces[i] for i in order], labels[order]
    counts = np.array([len(p[1]) for p in pieces])
    x = np.concatenate([p[2] for p in pieces]).astype(np.float32)
    of = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    # both labels weigh the same, and long pieces no more than short ones
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    each = share / counts
    truth = labels[of]
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    groups = np.array_split(np.arange(len(pieces)), 4)  # like widths together
    starts = np.cumsum(counts) - counts
    for step in range(1, steps + 1):
        weights, ties = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        evidence = (x @ weights.astype(np.float32)).astype(np.float64)
        chance = np.empty(len(of))
        tie_grad = np.zeros((2, 2))
        for g in groups:
            rows = slice(starts[g[0]], starts[g[-1]] + counts[g[-1]])
            good, pairs, _ = marginals(_padded(counts[g], evidence[rows]), counts[g], ties)
            chance[rows] = good[of[rows] - g[0], place[rows]]
            seen = np.zeros((2, 2))
            n_pairs = counts[g] - 1
            seen[1, 1], seen[0, 0] = n_pairs[labels[g] == 1].sum(), n_pairs[labels[g] == 0].sum()
            tie_grad += (seen - pairs) / max(len(of), 1)
        grad = np.append(x.T @ ((truth - chance) * each[of]).astype(np.float32), tie_grad.ravel()) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.2 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[N_FEATURES:] = np.clip(theta[N_FEATURES:], -3, 3)
    field = Field(theta[:N_FEATURES].copy(), theta[N_FEATURES:].reshape(2, 2).copy())
    sizes = np.concatenate([p[1] for p in pieces])
    field.slope, field.shift = _calibrate(field.means(counts, sizes, x), labels)
    return field


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose texts sum to about ``SLICE_BYTES``, with their bytes and offsets."""
    text = batch.column(column)
    big = text.cast(pa.large_string())
    offsets = np.frombuffer(big.buffers()[1], dtype=np.int64, count=len(big) + 1 + big.offset)[big.offset :]
    data = np.frombuffer(big.buffers()[2], dtype=np.uint8) if big.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(big):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at), data, offsets[at : to + 1]
        at = to


def sample_pieces(docs: DataFrame, labels: DataFrame, max_documents: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of a sample of labelled documents whose crc32(doc_id) mod 5 is not 0.

    The sample is the ``max_documents`` labelled ids that come first by a hash, and as many of their pieces at most.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    chosen = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_documents)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _slices(batch, 2):
                doc, size, features = line_features(data, offsets)
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                ids, quality = part.column(0).to_pylist(), part.column(1).to_pylist()
                made = [(ids[d], quality[d], at, size[at : min(at + PIECE, b)].astype("<i8").tobytes(), features[at : min(at + PIECE, b)].astype("<f4").tobytes()) for d, (a, b) in enumerate(zip(edges, edges[1:])) for at in range(a, b, PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["doc_id", "quality", "place", "sizes", "features"])

    pieces = rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, place long, sizes binary, features binary")
    order = [F.xxhash64("doc_id", "sizes"), "doc_id", "quality", F.xxhash64("features")]
    found = pieces.orderBy(*order).limit(max_documents).select("quality", "sizes", "features").collect()  # bounded by the sample
    return [(r.quality, np.frombuffer(r.sizes, "<i8"), np.frombuffer(r.features, "<f4").reshape(-1, N_FEATURES)) for r in found]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_documents: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality."""
    field = docs.sparkSession.sparkContext.broadcast(train(sample_pieces(docs, labels, max_documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _slices(batch, 2):
                doc, size, features = line_features(data, offsets)
                counts = np.bincount(doc, minlength=part.num_rows)
                s = field.value.scores(field.value.means(counts, size, features))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        give_back()

    held_out = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_documents: int = 6000) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns, whatever their names. Null texts are scored
    as empty ones and stay null."""
    field = docs.sparkSession.sparkContext.broadcast(train(sample_pieces(docs, labels, max_documents)))
    (text,) = unused(docs, "text")
    own = docs.withColumn(text, text_of())
    schema = own.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            for part, data, offsets in _slices(batch, at):
                doc, size, features = line_features(data, offsets)
                s = field.value.scores(field.value.means(np.bincount(doc, minlength=part.num_rows), size, features))
                kept = part.filter(pa.array(s >= threshold))
                yield pa.RecordBatch.from_arrays(kept.columns[:at], schema=pa.schema(list(kept.schema)[:at]))
        give_back()

    return own.mapInArrow(run, type(schema)(schema.fields[:-1]))
