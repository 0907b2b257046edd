"""Cost-balanced packing of token ids into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2`` (attention stays within
a document).  Per chunk of a partition, documents longer than a sequence first give
whole sequences; the remaining pieces go, longest first, to the sequence of lowest
cost that has room for them.  A piece that fits nowhere is cut at the largest room.
The chunk's rooms add up to its tokens, so sequences are full; only the chunk's last
sequences are shorter, each a power of two.  No shuffle is needed: a scan's
partitions pack on their own, and a chunk bounds the memory.  sequence_id is made of
the partition's number and a counter, so a task that runs again gives the same rows.

The vocabulary file is the installed public one unless a path is given.  An added token's
text (such as an end-of-text mark) becomes that token, as the tokenizer does by default.

Defined cases: a null or empty text has the end id alone; rows that share a doc_id,
or have none, are packed as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit
from . import textkit as tk
from .tokens import SLICE_BYTES, tokenizer

CAPACITY = 2048
#: Relative cost of a token and of a pair of tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CHUNK_TOKENS = 4_000_000
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences."""
    pieces, rest, n_seq = [], [], 0
    for i, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((i, k * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, i, whole * capacity))
    total = sum(r[0] for r in rest)
    tail = total % capacity
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    size, room, cost = np.array(rooms, np.int64), np.array(rooms, np.int64), np.zeros(len(rooms))
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, i, start in rest:
        while n:
            fits = np.flatnonzero(room >= n)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            put = min(n, int(room[s]))
            pieces.append((i, start, put, n_seq + s, int(size[s] - room[s])))
            room[s] -= put
            cost[s] += linear * put + quadratic * put * put
            n, start = n - put, start + put
    return pieces, n_seq + len(rooms)


def _pack(path: str | None, end_id: int | None, capacity: int, linear: float, quadratic: float, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, end_id)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        docs, blobs, held, used = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal used
            lengths = [len(b) // 4 for b in blobs]
            pieces, n_seq = assign(lengths, capacity, linear, quadratic)
            i, start, length, seq, offset = (np.array(c, np.int64) for c in (zip(*pieces, strict=True) if pieces else [[]] * 5))
            crc = [zlib.crc32(memoryview(blobs[a])[4 * b : 4 * (b + n)]) for a, b, n in zip(i.tolist(), start.tolist(), length.tolist(), strict=True)]
            cols = [pa.array(docs, pa.int64()).take(pa.array(i)), start, length, pa.array(crc, pa.int64()), np.array(lengths, np.int64)[i], seq + first + used, offset]
            used += n_seq
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=list(_FIELDS))

        for batch in batches:
            texts = batch.column(1)
            for a, z in tk.slices(*tk.buffers(texts), SLICE_BYTES):
                ids, coded = batch.column(0).slice(a, z - a).to_pylist(), tok.encode(texts.slice(a, z - a))
                for k in range(0, z - a, 256):
                    part = coded[k : k + 256]
                    docs += ids[k : k + 256]
                    blobs += part
                    held += sum(map(len, part)) // 4
                    if held >= chunk:
                        yield flush()
                        docs, blobs, held = [], [], 0
        if docs:
            yield flush()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 1, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(sparkkit.lean(_pack(path, end_id, capacity, linear, quadratic, chunk_tokens)), _SCHEMA)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(sparkkit.table(spark, sf_dir, "documents"))
