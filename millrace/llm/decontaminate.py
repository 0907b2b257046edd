"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage.

The index is over the items (they are few); the passages are the queries.  A term's
impact on an item is its BM25 weight over the item's own best score, so scores lie in
0..1 and one threshold serves items of all lengths.  Items are grouped in blocks, and
each term keeps its largest impact per block.

A passage's upper bounds (over all items, then per block) are summed for whole batches
at once, then, in the blocks left, per item over the terms it has; only blocks with an
item whose bound reaches the threshold are searched, item by item, by WAND: terms are ordered by their next item, the pivot is the first term at which the
summed bounds reach the threshold, and all items before it are skipped.  Every item at
or over the threshold is found.  Each is then verified in the text: word n-grams that
the passage shares with the item must cover enough of the question and of the answer.

Passages are windows of twice the longest item, half overlapping, so each stretch of
text as long as an item lies wholly in one.  There is no shuffle: a document's passages
stay in its task.  Items are indexed in shards of at most SHARD_BYTES of text, with
document frequencies over all items.  Shards are built and searched one after another,
each result written before the next, so the driver and the tasks hold one at a time.

Words are lowered (A-Z) runs of ASCII letters and digits or any non-ASCII signs.
An item without a question and an answer column is split before its last sentence;
an item of one sentence is its own answer.  Null or empty texts and items match
nothing; an item without an id counts like others and is reported with a null item_id; rows
that share a doc_id are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit
from . import textkit as tk

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, NGRAM = 0.6, 0.6, 5
BLOCK, MIN_PASSAGE = 16, 96
SHARD_BYTES = 16 << 20
#: Stands for a null item id in an index.
NO_ID = -(1 << 63)
_ROWS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_start long, word_end long"


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item given as one text."""
    t = (text or "").strip()
    cuts = [m.end() for m in re.finditer(r"[.?!]\s+", t)]
    return (t[: cuts[-1]], t[cuts[-1] :]) if cuts else (t, t)


def _hashed(texts: list[str]) -> list[np.ndarray]:
    data, off = tk.buffers(pa.array(texts, pa.string()))
    s, e, limits = tk.words(data, off, tk.PLAIN)
    h = tk.word_hashes(data, s, e, lower=True)
    return [h[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)]


@dataclass
class Index:
    """Terms (sorted hashes), their postings by item, and their block and overall bounds."""

    item_ids: np.ndarray
    terms: np.ndarray
    top: np.ndarray
    start: np.ndarray
    items: np.ndarray
    impact: np.ndarray
    block_start: np.ndarray
    blocks: np.ndarray
    block_top: np.ndarray
    post_start: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    passage: int


def build_index(rows: list[tuple[int, str, str]], longest: int, n_items: int, mean_words: float, df: dict[int, int] | None = None) -> Index:
    """Index of one shard of items (id, question, answer); df and the means are over all shards."""
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    q, a = _hashed([r[1] for r in rows]), _hashed([r[2] for r in rows])
    same = [r[1] == r[2] for r in rows]
    whole = [x if s else np.concatenate([x, y]) for x, y, s in zip(q, a, same, strict=True)]
    keep = [i for i, w in enumerate(whole) if len(w)]
    counts = [np.unique(whole[i], return_counts=True) for i in keep]
    terms = np.unique(np.concatenate([c[0] for c in counts])) if counts else np.zeros(0, tk.U64)
    t = np.searchsorted(terms, np.concatenate([c[0] for c in counts])) if counts else np.zeros(0, np.int64)
    item = np.repeat(np.arange(len(keep)), [len(c[0]) for c in counts])
    tf = np.concatenate([c[1] for c in counts]).astype(float) if counts else np.zeros(0)
    n_df = np.bincount(t, minlength=len(terms)) if df is None else np.array([df[int(x.view(np.int64))] for x in terms])
    idf = np.log(1 + (n_items - n_df + 0.5) / (n_df + 0.5))
    length = np.array([len(whole[i]) for i in keep], float)
    w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(mean_words, 1e-9)))
    w /= np.bincount(item, w, minlength=len(keep))[item]
    order = np.lexsort((item, t))
    t, item, w = t[order], item[order], w[order]
    start = np.searchsorted(t, np.arange(len(terms) + 1))
    block = item // BLOCK
    new = np.r_[True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])] if len(t) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return Index(
        np.array([rows[i][0] for i in keep], np.int64), terms, np.maximum.reduceat(w, start[:-1]) if len(w) else w, start, item, w,
        np.searchsorted(t[at], np.arange(len(terms) + 1)), block[at], np.maximum.reduceat(w, at) if len(w) else w, np.r_[at, len(w)],
        [(q[i], a[i]) for i in keep], max(MIN_PASSAGE, 2 * longest),
    )


def wand(ix: Index, terms: np.ndarray, lo: int, hi: int, threshold: float) -> list[tuple[int, float]]:
    """Items lo..hi-1 whose summed impacts over ``terms`` reach the threshold."""
    cursors = []
    for t in terms.tolist():
        a, z = int(ix.start[t]), int(ix.start[t + 1])
        a, z = a + int(np.searchsorted(ix.items[a:z], lo)), a + int(np.searchsorted(ix.items[a:z], hi))
        if a < z:
            cursors.append([ix.items[a:z].tolist(), ix.impact[a:z].tolist(), 0, float(ix.impact[a:z].max())])
    out = []
    while cursors:
        cursors.sort(key=lambda c: c[0][c[2]])
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += c[3]
            if bound >= threshold - 1e-9:
                pivot = c[0][c[2]]
                break
        if pivot is None:
            break
        del k
        if cursors[0][0][cursors[0][2]] == pivot:
            score = sum(c[1][c[2]] for c in cursors if c[0][c[2]] == pivot)
            if score >= threshold - 1e-9:
                out.append((pivot, score))
            to = pivot + 1
        else:
            to = pivot
        live = []
        for c in cursors:
            while c[2] < len(c[0]) and c[0][c[2]] < to:
                c[2] += 1
            if c[2] < len(c[0]):
                live.append(c)
        cursors = live
    return out


def _covered(part: np.ndarray, text: np.ndarray) -> float:
    """Share of a part's words that lie in word n-grams which the text has too."""
    n = min(NGRAM, len(part))
    if not n:
        return 1.0
    own, there = tk.rolling(part, n, tk.BASES[0]), tk.rolling(text, n, tk.BASES[0])
    hit = np.isin(own, there)
    delta = np.zeros(len(part) + 1, np.int64)
    np.add.at(delta, np.flatnonzero(hit), 1)
    np.add.at(delta, np.flatnonzero(hit) + n, -1)
    return float((np.cumsum(delta[:-1]) > 0).mean())


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi-1, and which range each is of."""
    n = hi - lo
    entry = np.repeat(np.arange(len(n)), n)
    return np.arange(len(entry)) - (np.cumsum(n) - n)[entry] + lo[entry], entry


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys' names in order, and each key's place among them; no sort where the keys' range is small."""
    if not len(keys):
        return keys, keys
    least, span = int(keys.min()), int(keys.max()) - int(keys.min()) + 1
    if span > 1 << 25:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[keys - least] = True
    names = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    return names + least, place[keys - least]


def search(ix: Index, h: np.ndarray, limits: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, int, int]]:
    """Verified (row, item, score, question overlap, answer overlap, first word, last word + 1) of a batch's word hashes."""
    if not len(ix.terms) or not len(h):
        return []
    at = np.searchsorted(ix.terms, h)
    at[at == len(ix.terms)] = 0
    known = ix.terms[at] == h
    word = np.flatnonzero(known)
    term = at[word]
    row = np.searchsorted(limits, word, side="right") - 1
    half = ix.passage // 2
    own = (word - limits[row]) // half
    n_pass = np.maximum(-(-np.diff(limits) // half), 1)
    base = np.cumsum(n_pass) - n_pass
    p = base[row] + own
    # a word lies in the passage that starts in its half, and in the one before
    p, term = np.concatenate([p, p[own > 0] - 1]), np.concatenate([term, term[own > 0]])
    key = np.unique(p * len(ix.terms) + term)
    p, term = key // len(ix.terms), key % len(ix.terms)
    if not len(p):
        return []
    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    may = np.add.reduceat(ix.top[term], cut) >= threshold - 1e-9
    live = np.repeat(may, np.diff(np.r_[cut, len(p)]))
    p, term = p[live], term[live]
    if not len(p):
        return []
    n_blocks = int(ix.blocks.max()) + 1
    flat, entry = _ranges(ix.block_start[term], ix.block_start[term + 1])
    pairs = p[entry] * n_blocks + ix.blocks[flat]
    _, inverse = _dense(pairs)
    ok = (np.bincount(inverse, ix.block_top[flat]) >= threshold - 1e-9)[inverse]
    pairs, flat = pairs[ok], flat[ok]
    # within those blocks: an item can be a pivot only if the bounds of its own terms reach the threshold
    post, entry = _ranges(ix.post_start[flat], ix.post_start[flat + 1])
    names, inverse = _dense(pairs[entry] * BLOCK + ix.items[post] % BLOCK)
    hot = np.unique(names[np.bincount(inverse, ix.block_top[flat][entry], minlength=len(names)) >= threshold - 1e-9] // BLOCK)
    best: dict[tuple[int, int], tuple] = {}
    for pb in hot.tolist():
        q, b = divmod(pb, n_blocks)
        lo, hi = np.searchsorted(p, [q, q + 1])
        for i, score in wand(ix, term[lo:hi], b * BLOCK, (b + 1) * BLOCK, threshold):
            r = int(np.searchsorted(base, q, side="right") - 1)
            w0 = int(limits[r] + (q - base[r]) * half)
            w1 = int(min(w0 + ix.passage, limits[r + 1]))
            question, answer = (_covered(x, h[w0:w1]) for x in ix.parts[i])
            if question >= overlap and answer >= overlap and ((r, i) not in best or score > best[r, i][2]):
                best[r, i] = (r, i, score, question, answer, w0 - int(limits[r]), w1 - int(limits[r]))
    return list(best.values())


def _search_batch(ix: Index, texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple]:
    data, off = tk.buffers(texts)
    for a, z in tk.slices(data, off):
        d = data[off[a] : off[z]]
        s, e, limits = tk.words(d, off[a : z + 1] - off[a], tk.PLAIN)
        for r, *rest in search(ix, tk.word_hashes(d, s, e, lower=True), limits, threshold, overlap):
            yield (a + r, *rest)


def item_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None) -> Iterator[tuple[Index, bool]]:
    """Indexes of all items, each over at most about SHARD_BYTES of text, and whether others follow or came before."""
    if question_col and answer_col:
        src = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(question_col, F.lit("")).alias("q"), F.coalesce(answer_col, F.lit("")).alias("a"), F.concat_ws(" ", question_col, answer_col).alias("t"))
    else:
        src = items.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("a"), F.col(text_col).alias("t"))
    src = src.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    words = F.size(F.filter(F.split(F.col("t"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    stat = src.agg(F.sum(F.octet_length("t")).alias("bytes"), F.count_if(words > 0).alias("n"), F.max(words).alias("longest"), F.avg(F.when(words > 0, words)).alias("mean")).first()
    shards = max(1, math.ceil((stat["bytes"] or 0) / SHARD_BYTES))
    for k in range(shards):
        part = src if shards == 1 else src.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == k)
        rows = [(r["id"], *((r["q"], r["a"]) if question_col and answer_col else split_item(r["t"]))) for r in part.collect()]
        df = None if shards == 1 else _frequencies(src, rows)
        yield build_index(rows, int(stat["longest"] or 1), int(stat["n"] or 0), float(stat["mean"] or 1.0), df), shards > 1


def _frequencies(src: DataFrame, rows: list[tuple[int, str, str]]) -> dict[int, int]:
    """How many of all items have each term of a shard."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.concatenate([np.unique(h) for h in _hashed(b.column(0).to_pylist())] or [np.zeros(0, tk.U64)])
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64))], names=["term"])

    own = np.unique(np.concatenate([h for r in rows for h in _hashed([f"{r[1]} {r[2]}"])] or [np.zeros(0, tk.U64)]))
    spark = src.sparkSession
    wanted = spark.createDataFrame(pa.table({"term": own.view(np.int64)}))
    got = src.select("t").mapInArrow(terms, "term long").groupBy("term").count().join(wanted, "term").collect()
    return {r["term"]: r["count"] for r in got}


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **item_cols: str) -> DataFrame:
    """One row per document row and verified item, with the best passage."""
    out = None
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for ix, several in item_shards(items, **item_cols):

        def run(batches: Iterator[pa.RecordBatch], ix: Index = ix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(r, None if ix.item_ids[i] == NO_ID else int(ix.item_ids[i]), s, q, a, x, y) for r, i, s, q, a, x, y in _search_batch(ix, batch.column(1), threshold, overlap)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:5]], *[pa.array(c, pa.int64()) for c in cols[5:]]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word_start", "word_end"])

        part = src.mapInArrow(run, _ROWS)
        part = sparkkit.cut(part) if several else part
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **item_cols: str) -> DataFrame:
    """The input's rows in which no item is found, with all their columns."""
    at = docs.columns.index(text_col)
    for ix, several in item_shards(items, **item_cols):

        def run(batches: Iterator[pa.RecordBatch], ix: Index = ix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for hit in _search_batch(ix, batch.column(at), threshold, overlap):
                    keep[hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        docs = sparkkit.cut(docs) if several else docs
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(sparkkit.table(spark, sf_dir, "documents"), sparkkit.table(spark, sf_dir, "benchmark"))
