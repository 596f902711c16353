"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens with their lengths in tokens: the most frequent ones of a bounded sample of
the documents, so its size is bounded whatever the corpus. Tier two is a cache in each Python worker that holds what tier one
lacks; a miss there is encoded once. Pre-tokens are never shuffled, and both tiers change only the speed: a full cache is emptied
and filled anew.

A plain text without doubled white space is cut at its spaces first, and a cut piece's total is cached as a whole, since no
pre-token reaches over a single space from the left. Other plain texts are cut by the rule of the format, texts in other scripts
by the library's own, in its byte alphabet. Only texts that hold a special string go to the library whole.

Null and empty texts have no tokens; texts of any length are counted whole; repeated rows are counted each. Other columns of the
documents are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter as Tally
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of
from .tokens import PLAIN_PATTERN, Encoder, encoder

#: White space beside a space, or a space at the end: here a cut at spaces would not respect pre-tokens.
_CLOSE = re.compile(r" [\s]|[\t-\r] | \Z")


class _Bounded(dict):
    """A cache of at most ``most`` entries, filled through ``compute`` on a miss."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.compute(key)
        return value


Tier = tuple[dict[str, int], dict[str, int]]  # by plain pre-tokens, and by those in the library's byte alphabet


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, enc: Encoder, frequent: Tier, most: int):
        self.enc, (self.frequent, self.frequent_exact) = enc, frequent
        self.pieces = _Bounded(lambda piece: len(enc.fast.encode_ordinary(piece)), most)
        self.exact_pieces = _Bounded(enc.exact_length, most)
        self.spaced = _Bounded(lambda chunk: self.by_piece(" " + chunk), most)

    def by_piece(self, text: str) -> int:
        first, second = self.frequent.get, self.pieces.__getitem__
        return sum(first(p) or second(p) for p in PLAIN_PATTERN.findall(text))

    def count(self, text: str) -> int:
        if not self.enc.plain(text):
            if not self.enc.split_exactly or any(s in text for s in self.enc.special):
                return len(self.enc.exact.encode(text, add_special_tokens=False))
            first, second = self.frequent_exact.get, self.exact_pieces.__getitem__
            return sum(first(p) or second(p) for p in self.enc.exact_pieces(text))
        if _CLOSE.search(text):
            return self.by_piece(text)
        head, *rest = text.split(" ")
        return self.by_piece(head) + sum(map(self.spaced.__getitem__, rest))


def frequent_lengths(docs: DataFrame, tokenizer_path: str, sample_documents: int = 2000, entries: int = 65_536, longest: int = 64) -> Tier:
    """The pre-tokens of at most ``longest`` characters that are most frequent in a sample of documents, with their lengths.

    The sample are the documents that come first by a hash of id and text (and rows that repeat the last of them). Pieces are counted
    in each batch before they meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            plain, exact = Tally(), Tally()
            for t in batch.column(0).to_pylist():
                if enc.plain(t):
                    plain.update(PLAIN_PATTERN.findall(t))
                elif enc.split_exactly:
                    exact.update(enc.exact_pieces(t))
            made = [(p, k, n) for k, tally in enumerate((plain, exact)) for p, n in tally.items() if len(p) <= longest]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * 3, [pa.string(), pa.int32(), pa.int64()])], names=["piece", "kind", "n"])

    # hashes alone meet in one place; the texts are read where they are
    h = F.xxhash64("doc_id", text_of())
    last = docs.select(h.alias("h")).orderBy("h").limit(sample_documents).agg(F.max("h")).first()[0] if sample_documents else None
    texts = docs.where(h <= last if last is not None else F.lit(False)).select(text_of().alias("text"))
    found = texts.mapInArrow(run, "piece string, kind int, n long").groupBy("piece", "kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind", "piece").limit(entries).collect()
    enc = encoder(tokenizer_path)
    return {r.piece: len(enc.fast.encode_ordinary(r.piece)) for r in found if not r.kind}, {r.piece: enc.exact_length(r.piece) for r in found if r.kind}


_OPEN: dict[tuple, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, cache_entries: int = 400_000, sample_documents: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, tokenizer_path, sample_documents))
    table = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, cache_entries, table)
        if key not in _OPEN:
            _OPEN.clear()  # one table at a time
            _OPEN[key] = Counter(encoder(tokenizer_path), frequent.value, cache_entries)
        counter = _OPEN[key]
        for batch in batches:
            text = batch.column(1)
            n = pa.array([counter.count(t.as_py()) for t in text], pa.int64())
            size = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
