"""Exact substring deduplication over fixed-length word windows (Rabin-Karp).

Plan, for any size of corpus:

1. *Hash.*  One scan rolls a 64-bit Rabin-Karp hash (and a second lane) over the
   word hashes of every text.  Each chunk of documents keeps, per window hash,
   only the occurrences in its smallest document: all others in the chunk are
   repeats already, whatever the rest of the corpus holds.  So a passage that a
   third of all documents share costs one entry per chunk, not per document.
2. *Count.*  Entries are packed by hash bucket and shuffled once; a bucket's task
   sorts its entries and finds, per hash, the smallest document.
3. *Merge and cut.*  Repeated window starts go to their document's bucket, where
   they are merged into maximal intervals and cut out of the text.

A window is identified by 64 bits of the first lane and, through the bucket, at
least 4 (at 100 TB: 20) bits of the second; at 100 TB about 2.7e13 windows give some
twenty expected chance collisions in the whole corpus.  No window is sampled or capped.

Defined cases: null or empty text has no words, and gives n_words 0 and the hash of
the empty string.  Rows with the same doc_id never make each other's windows repeat, and
each loses only windows that it has itself: a start travels with 32 bits of its window's
hash, and a row takes it only if its own window there has them.
A null doc_id is neither smaller nor larger than any other: its row stays whole.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed, sparkkit
from . import textkit as tk

WIDTH = 13
#: Words whose windows are held in memory at once, per task.
CHUNK_WORDS = 1_500_000
_ROWS = "bucket int, kind int, payload binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
#: Kinds of a packed row.
ENTRY, FOUND, TEXT = 0, 1, 2


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], schema=_SCHEMA)


def _by(bucket: np.ndarray, kind: int, names: dict[str, np.ndarray], offset: int = 0) -> pa.RecordBatch:
    """One packed row per bucket; the order within a bucket is kept."""
    if not len(bucket):
        return _batch([])
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cols = {k: v[order] for k, v in names.items()}
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    rows = []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(b)], strict=True):
        rows.append((int(b[lo]) + offset, kind, packed.dump({k: v[lo:hi] for k, v in cols.items()})))
    return _batch(rows)


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(doc.astype(np.int64).view(tk.U64)) & tk.U64(n - 1)).astype(np.int32)


def check(h: np.ndarray) -> np.ndarray:
    """The bits of a window's hash that go with its start, to tell the rows of one doc_id apart."""
    return (h >> tk.U64(32)).astype(np.uint32)


def _hash_chunks(width: int, n_hash: int, n_doc: int):
    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, pos, h, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        group = np.cumsum(np.r_[True, hs[1:] != hs[:-1]]) - 1
        least = np.minimum.reduceat(ds, first)
        later = np.zeros(len(h), bool)
        later[order] = ds > least[group]
        if later.any():
            d, p = doc[later], pos[later]
            yield _by(doc_bucket(d, n_doc), FOUND, {"d": d, "p": p, "c": check(h[later])}, n_hash)
        own = ~later
        yield _by(b[own], ENTRY, {"h": h[own], "d": doc[own], "p": pos[own]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, off = tk.buffers(batch.column(1))
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0), dtype=np.int64)
            for a, z in tk.slices(data, off):
                d = data[off[a] : off[z]]
                s, e, limits = tk.words(d, off[a : z + 1] - off[a])
                at, rows = tk.window_starts(limits, width)
                if not len(at):
                    continue
                h = tk.word_hashes(d, s, e)
                h1, h2 = tk.rolling(h, width, tk.BASES[0])[at], tk.rolling(h, width, tk.BASES[1])[at]
                ok = known[a:z][rows]
                at, rows, h1, h2 = at[ok], rows[ok], h1[ok], h2[ok]
                if not len(at):
                    continue
                parts.append((ids[a:z][rows], (at - limits[rows]).astype(np.uint32), h1, (h2 & tk.U64(n_hash - 1)).astype(np.int32)))
                held += len(at)
                if held >= CHUNK_WORDS:
                    yield from flush(parts)
                    held = 0
        if parts:
            yield from flush(parts)

    return run


def _count(n_hash: int, n_doc: int):
    """Rows come sorted by bucket; one bucket is in memory at a time."""

    def repeats(held: list[bytes], found: list[tuple[np.ndarray, ...]]) -> int:
        cols = packed.load_all(held)
        held.clear()
        h, d, p = cols["h"], cols["d"], cols["p"]
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        new = np.r_[True, h[1:] != h[:-1]]
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(d, first)
        later = d > least[np.cumsum(new) - 1]
        found.append((d[later], p[later], check(h[later])))
        return int(later.sum())

    def emit(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        d, p, c = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.argsort(d, kind="stable")
        return _by(doc_bucket(d[order], n_doc), FOUND, {"d": d[order], "p": p[order], "c": c[order]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, n = None, [], [], 0
        for batch in batches:
            passed = []
            for bucket, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == FOUND:
                    passed.append((bucket - n_hash, FOUND, payload))
                    continue
                if bucket != now and held:
                    n += repeats(held, found)
                    if n >= CHUNK_WORDS:
                        yield emit(found)
                        n = 0
                now = bucket
                held.append(payload)
            if passed:
                yield _batch(passed)
        if held:
            repeats(held, found)
        if found:
            yield emit(found)

    return run


def _pack_texts(n_doc: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(-1), dtype=np.int64)
            b = doc_bucket(ids, n_doc)
            order = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]]) if len(b) else []
            t = pa.Table.from_batches([batch]).take(pa.array(order))
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True):
                rows.append((int(b[order[lo]]), TEXT, packed.dump_table(t.slice(lo, hi - lo))))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return run


def _cut_texts(width: int, with_text: bool):
    """Rows come sorted by document bucket, repeats before texts."""

    def own(text: bytes, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The starts whose window this very text has there; other rows of the id may have given the rest."""
        data = np.frombuffer(text, np.uint8)
        s, e, _ = tk.words(data, np.array([0, len(data)], np.int64))
        if len(s) < width:
            return at[:0]
        have = check(tk.rolling(tk.word_hashes(data, s, e), width, tk.BASES[0]))
        inside = at <= len(s) - width
        at, c = at[inside], c[inside]
        return at[have[at] == c]

    def merged(starts: np.ndarray, n: int) -> np.ndarray:
        delta = np.zeros(n + 1, np.int64)
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + width, -1)
        return np.cumsum(delta[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, starts, checks, docs = None, [], None, None, None
        for batch in batches:
            for bucket, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, found, docs = bucket, [], None
                if kind == FOUND:
                    found.append(payload)
                    continue
                if docs is None:
                    cols = packed.load_all(found) if found else {"d": np.zeros(0, np.int64), "p": np.zeros(0, np.uint32), "c": np.zeros(0, np.uint32)}
                    order = np.argsort(cols["d"], kind="stable")
                    docs, starts, checks, found = cols["d"][order], cols["p"][order].astype(np.int64), cols["c"][order], []
                t = packed.load_table(payload)
                out = []
                for doc, text in zip(t.column(0).to_pylist(), t.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = (text or b"").split()
                    lo, hi = (np.searchsorted(docs, doc, "left"), np.searchsorted(docs, doc, "right")) if doc is not None else (0, 0)
                    kept = words
                    if hi > lo:
                        kept = list(compress(words, (~merged(own(text or b"", starts[lo:hi], checks[lo:hi]), len(words))).tolist()))
                    kept_bytes = b" ".join(kept)
                    out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(kept_bytes).hexdigest(), kept_bytes.decode() if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and (if asked) kept_text, without repeated windows."""
    if width < 1:
        raise ValueError("width must be positive")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_hash = n_doc = sparkkit.buckets(docs, 8 << 20, per_partition=2)
    entries = src.mapInArrow(_hash_chunks(width, n_hash, n_doc), _ROWS)
    parts = sparkkit.partitions(docs.sparkSession)
    found = sparkkit.deal(entries, "bucket", parts).sortWithinPartitions("bucket").mapInArrow(_count(n_hash, n_doc), _ROWS)
    texts = src.mapInArrow(_pack_texts(n_doc), _ROWS)
    both = sparkkit.deal(found.unionByName(texts), "bucket", parts).sortWithinPartitions("bucket", "kind")
    out = both.mapInArrow(_cut_texts(width, with_text), _RESULT)
    return out if with_text else out.drop("kept_text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(sparkkit.table(spark, sf_dir, "documents"), with_text=False)
