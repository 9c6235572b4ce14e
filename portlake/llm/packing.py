"""Packing by powers of two: each document is cut into pieces of binary lengths, one piece a sequence.

A document of n ids becomes floor(n / size) pieces of `size` ids and one piece for each binary digit of the
rest, longest first.  Every piece fills a sequence of its own length, so nothing is padded and no sequence
crosses documents.  Sequences of one length are numbered together: the number carries the length's rank, the
task and a running number, so it needs no shuffle and is unique whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text, vocab

_TASK_BITS, _RUN_BITS = 24, 34


def binary_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `n` ids; `size` is a power of two."""
    pieces = [(k * size, size) for k in range(n // size)]
    start = n - n % size
    for bit in range(size.bit_length() - 2, -1, -1):
        if n >> bit & 1:
            pieces.append((start, 1 << bit))
            start += 1 << bit
    return pieces


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text has only its end id.  Repeated rows and repeated or null ids are packed like any
    other row.  Texts of any length are packed whole.  An empty table gives no rows.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        task = TaskContext.get().partitionId()
        used = [0] * size.bit_length()
        model = vocab.tokens(vocabulary)
        for b in text.slices(batches, vocab.SLICE_BYTES):
            rows: list[list] = [[] for _ in range(6)]
            ids, ends = model.encode(b.column("text"))
            ids = np.insert(ids.astype("<u4"), ends, end_id)
            ends += np.arange(1, len(ends) + 1)
            data, begin = ids.tobytes(), 0  # slices of bytes: Arrow would keep views of a memoryview alive
            for doc, stop in zip(b.column("doc_id").to_pylist(), ends.tolist()):
                for start, length in binary_pieces(stop - begin, size):
                    rank = size.bit_length() - length.bit_length()
                    rows[0].append(doc)
                    rows[1].append(start)
                    rows[2].append(length)
                    rows[3].append(data[4 * (begin + start) : 4 * (begin + start + length)])
                    rows[4].append(stop - begin)
                    rows[5].append((rank << _TASK_BITS | task) << _RUN_BITS | used[rank])
                    used[rank] += 1
                begin = stop
            yield text.batch_of(schema, *rows, np.zeros(len(rows[0]), np.int64))

    rows = text.text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(text.tidy(run, "packing"), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
