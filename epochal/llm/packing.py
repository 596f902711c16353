"""Packing by power-of-two decomposition.

Each document becomes its token ids and an end id, cut into pieces whose lengths are powers of two: as many pieces of the
greatest length as fit, then the binary digits of the rest from the greatest down. A piece is a sequence of its own, so no
sequence crosses documents and none needs padding; sequences of equal length share a bucket, from which a trainer draws
batches of one shape. The work is one pass over the documents without a shuffle.

Null texts count as empty and give the end id alone. Repeated rows give repeated pieces with sequences of their own; texts of any
length are cut whole. Other columns of the documents are not read, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, text_of
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_lengths(n: int, most: int) -> list[int]:
    """Powers of two of at most ``most`` (itself one) that sum to ``n``, in falling order."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_binary(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): one row each, as in ``SCHEMA``, with ``ids array<int>`` where asked for.

    ``bucket`` is the binary logarithm of the length. ``sequence_id`` is unique; it follows from the partition and the row,
    so a task that runs again gives the same.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    schema = SCHEMA + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                kept: list[np.ndarray] = []
                part = batch.slice(at, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.append(enc.ids(text.as_py() or ""), np.array([end_id], dtype="<u4"))
                    start = 0
                    for n in binary_lengths(len(ids), max_length):
                        piece = ids[start : start + n]
                        out.append((doc, start, n, zlib.crc32(piece.tobytes()), len(ids), sequence, 0, n.bit_length() - 1))
                        kept.append(piece)
                        start, sequence = start + n, sequence + 1
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 7 + [pa.int32()])]
                if with_ids:
                    ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a reader takes batches of one shape without looking at the others."""
    pieces.write.partitionBy("bucket").parquet(path)
