"""Near-duplicate components: MinHash bands, odd sketches, exact confirmation.

1. One scan makes each document's set of word-shingle hashes.  Rows with equal sets
   in a chunk become one row with a list of ids, so copies are grouped before any
   shuffle; a grouped minimum then names each class by its smallest id.
2. MinHash samples of the class representatives give band keys.  Keys held by one
   class alone go.  Samples are also folded into an odd sketch: a bitmap in which
   sample i flips the bit hash(i, sample).  The population count of two sketches'
   XOR estimates high similarities closely.
3. Per band bucket, candidates whose estimate is at least the threshold less 5.5
   standard deviations are linked.  The connected parts are families: no true link
   leaves its family.
4. Within families, pairs are confirmed on the full sets.  The confirmed links'
   components are the answer.

Steps 3 and 4 settle their groups in the same two rounds.  A group is dealt out in
blocks of about BLOCK members (fewer, where sets are long), and its hub, the smallest
id, goes to each of them.  In a block every member is compared with the hub first and
then with those it is not connected to; a spanning set of links, one fewer than the
members at most, leaves the task.  After the components of these links, only members
of large groups that are not connected with their hub are left over: they alone visit
the other blocks, in blocks of their own.  So the links are linear in a group's size,
and so is the shuffle for groups whose members resemble their hub; u members that do
not cost u / BLOCK copies of the group.

Texts are scanned for the samples, for the sets of each round, and twice more to drop rows.
Only those of families and of dropped rows are shuffled: a broadcast bitmap of ids holds
the others back, but for the few whose hash meets another's.

No pair of rows is ever made by a join, no partner or candidate is capped, and copies
are never expanded into pairs.  The bands miss a pair at the threshold with a chance
of about 1e-9 (0.85) or 6e-7 (0.8).

Defined cases: words are lowered A-Z only.  With fewer words than a shingle the whole
sequence is the one shingle; with none the set is empty and links with nothing.  Rows
that share a doc_id are one document with each of their texts.  A null doc_id links
with nothing: component_id null, kept true.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit
from . import textkit as tk

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, SKETCH_BITS = 36, 5, 512
#: Most members of a block on average, and shingles in it.
BLOCK, BLOCK_SHINGLES = 256, 1 << 22
#: Documents and shingles that a task groups before it hands them on.
CHUNK_DOCS, CHUNK_SHINGLES = 16384, 1 << 23
_SAMPLES = BANDS * ROWS
_SIG = "fp1 long, fp2 long, n long, ids array<long>, bands array<long>, sketch binary"

_seed = tk.mix(np.arange(1, 2 * _SAMPLES + 1, dtype=tk.U64) * tk.U64(tk.BASES[0]))
_XOR = (_seed[:_SAMPLES] >> tk.U64(32)).astype(np.uint32)
_MUL = (_seed[_SAMPLES:] >> tk.U64(32)).astype(np.uint32) | np.uint32(1)
_LANE = tk.mix(np.arange(1, _SAMPLES + 1, dtype=tk.U64) * tk.U64(tk.BASES[1]))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    out = []
    for a, z in tk.slices(data, off):
        d = data[off[a] : off[z]]
        s, e, limits = tk.words(d, off[a : z + 1] - off[a])
        h = tk.word_hashes(d, s, e, lower=True)
        r = tk.rolling(h, width, tk.BASES[0])
        for lo, hi in zip(limits[:-1], limits[1:], strict=True):
            if hi - lo >= width:
                out.append(np.unique(r[lo : hi - width + 1]))
            elif hi > lo:
                out.append(tk.rolling(h[lo:hi], int(hi - lo), tk.BASES[1]) + tk.U64(hi - lo))
            else:
                out.append(np.zeros(0, tk.U64))
    return out


def samples(u: np.ndarray) -> np.ndarray:
    """The MinHash sample of a set."""
    v = (u >> tk.U64(32)).astype(np.uint32)
    least = np.full(_SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(v), 512):
        np.minimum(least, ((v[k : k + 512, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    m = tk.mix(least.astype(tk.U64) + _LANE).reshape(BANDS, ROWS)
    acc = m[:, 0].copy()
    for j in range(1, ROWS):
        acc = tk.mix(acc * tk.U64(5) ^ m[:, j])
    return acc.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    at = (tk.mix(least.astype(tk.U64) ^ _LANE) % tk.U64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8))


def max_flips(percent: int) -> int:
    """XOR population count that a pair at the threshold exceeds by chance once in some 1e8 cases."""
    j, k, n = percent / 100, _SAMPLES, SKETCH_BITS
    mean = lambda d: n / 2 * (1 - math.exp(-2 * d / n))
    flips = 2 * k * (1 - j)
    sd = 2 * math.sqrt(k * j * (1 - j)) * math.exp(-2 * flips / n)
    return math.ceil(mean(flips) + 5.5 * math.sqrt(sd * sd + mean(flips) / 2))


def flips(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """XOR population counts of sketches (rows of 8 words each), with broadcasting."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: dict) -> pa.RecordBatch:
        rows = []
        for (f1, f2, n), (ids, u) in held.items():
            if n and f1 is not None and ids[0] is not None:
                least = samples(u)
                rows.append((f1, f2, n, ids, band_keys(least).tolist(), odd_sketch(least).tobytes()))
            else:
                rows.append((None, None, n, ids, None, None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["fp1", "fp2", "n", "ids", "bands", "sketch"])

    held, n_docs, n_held = {}, 0, 0
    for batch in batches:
        data, off = tk.buffers(batch.column(1))
        for doc, u in zip(batch.column(0).to_pylist(), shingle_sets(data, off), strict=True):
            if doc is None or not len(u):
                key = (None, None if doc is None else doc, len(u))
            else:
                key = (int(tk.mix(u).sum().view(np.int64)), int(np.bitwise_xor.reduce(tk.mix(u + tk.U64(tk.BASES[1]))).view(np.int64)), len(u))
            got = held.get(key)
            if got is None:
                held[key] = ([doc], u)
                n_held += len(u)
            else:
                got[0].append(doc)
            n_docs += 1
            if n_held >= CHUNK_SHINGLES:
                yield flush(held)
                held, n_docs, n_held = {}, 0, 0
        if n_docs >= CHUNK_DOCS:
            yield flush(held)
            held, n_docs, n_held = {}, 0, 0
    if held:
        yield flush(held)


class _Sets:
    def __init__(self, n: int):
        self.p = list(range(n))

    def root(self, x: int) -> int:
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.p[max(x, y)] = min(x, y)
        return x != y


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows come sorted by the first columns."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        keys = [np.asarray(t.column(i)) for i in range(n_keys)]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks()


def _cuts(t: pa.Table, n_keys: int) -> np.ndarray:
    keys = [np.asarray(t.column(i)) for i in range(n_keys)]
    new = np.ones(t.num_rows, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.r_[np.flatnonzero(new), t.num_rows]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _fixed(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _sketched(most: int):
    """Links of rows whose sketches are near.  Gives the pairs of a block, and those of two blocks that join labels."""

    def block(ids: np.ndarray, payload: pa.ChunkedArray) -> list[tuple[int, int]]:
        sk = _fixed(payload)
        near = flips(sk, sk[0]) <= most
        pairs = [(0, i) for i in np.flatnonzero(near[1:] & (ids[1:] != ids[0])) + 1]
        if near.all():
            return pairs
        sets = _Sets(len(ids))
        for i in np.flatnonzero(near).tolist():
            sets.join(0, i)
        for i in np.flatnonzero(~near).tolist():
            for j in np.flatnonzero(flips(sk, sk[i]) <= most).tolist():
                if sets.join(i, j):
                    pairs.append((i, j))
        return pairs

    def visit(payload: pa.ChunkedArray, own: np.ndarray, guests: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
        sk, sets, pairs = _fixed(payload), _Sets(int(labels.max()) + 1), []
        for g in guests.tolist():
            for i in own[flips(sk[own], sk[g]) <= most].tolist():
                if sets.join(int(labels[g]), int(labels[i])):
                    pairs.append((g, i))
        return pairs

    return block, visit


def _confirmed(percent: int, most: int):
    """Links of rows whose full sets are alike, as above."""

    def sets_of(payload: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        us = [np.frombuffer(b, np.uint64) for b in payload.to_pylist()]
        return us, np.stack([odd_sketch(samples(u)) for u in us]).view(np.uint64), np.array([len(u) for u in us])

    def alike(u: np.ndarray, v: np.ndarray) -> bool:
        both = len(u) + len(v) - len(np.union1d(u, v))
        return 100 * both >= percent * (len(u) + len(v) - both)

    def close(sk: np.ndarray, size: np.ndarray, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the others, those that may be alike to i, and their flips."""
        x = flips(sk[others], sk[i])
        ok = (x <= most) & (100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others]))
        return others[ok], x[ok]

    def take(us: list[np.ndarray], sets: _Sets, labels: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
        """Confirms found candidates, the closest first, unless they are connected by then."""
        if not found:
            return []
        i = np.concatenate([np.full(len(j), i) for i, j, _ in found])
        j, x = np.concatenate([j for _, j, _ in found]), np.concatenate([x for _, _, x in found])
        order, pairs = np.argsort(x, kind="stable"), []
        for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if sets.root(int(labels[p])) != sets.root(int(labels[q])) and alike(us[p], us[q]):
                sets.join(int(labels[p]), int(labels[q]))
                pairs.append((p, q))
        return pairs

    def block(ids: np.ndarray, payload: pa.ChunkedArray) -> list[tuple[int, int]]:
        us, sk, size = sets_of(payload)
        n = len(us)
        sets, at = _Sets(n), np.arange(n)
        pairs = take(us, sets, at, [(0, *close(sk, size, 0, at[1:]))])
        for i in range(1, n):
            if ids[i] == ids[0]:
                sets.join(0, i)
        left = [i for i in range(1, n) if sets.root(i) != sets.root(0)]
        return pairs + take(us, sets, at, [(i, *close(sk, size, i, at[at != i])) for i in left])

    def visit(payload: pa.ChunkedArray, own: np.ndarray, guests: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
        us, sk, size = sets_of(payload)
        sets = _Sets(int(labels.max()) + 1)
        return take(us, sets, labels, [(g, *close(sk, size, g, own[labels[own] != labels[g]])) for g in guests.tolist()])

    return block, visit


def _in_blocks(block):
    """Rows (key, blk, id, payload), sorted by the first three: links of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2):
            cuts, ids, out = _cuts(t, 2), np.asarray(t.column(2)), []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if z - a > 1:
                    out += [(ids[a + i], ids[a + j]) for i, j in block(ids[a:z], t.column(3).slice(a, z - a)) if ids[a + i] != ids[a + j]]
            if out:
                yield _edges(out)

    return run


def _in_visits(visit):
    """Rows (key, blk, guests, guest, label, id, payload), sorted by the first three: links of guests with a block's own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            cuts, out = _cuts(t, 3), []
            guest, label, ids = (np.asarray(t.column(i)) for i in (3, 4, 5))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                g = guest[a:z]
                if not g.all() and g.any():
                    labels = np.unique(label[a:z], return_inverse=True)[1]
                    out += [(ids[a + i], ids[a + j]) for i, j in visit(t.column(6).slice(a, z - a), np.flatnonzero(g == 0), np.flatnonzero(g), labels) if ids[a + i] != ids[a + j]]
            if out:
                yield _edges(out)

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tk.buffers(batch.column(0))
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            sets = shingle_sets(data[off[lo] : off[lo + part.num_rows]], off[lo : lo + part.num_rows + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([u.tobytes() for u in sets], pa.binary())], names=[*part.schema.names[1:], "set"])


def _dealt(members: DataFrame, payload: str) -> DataFrame:
    """Members (key, nb, hub, id) in their block; the hub in each of its group's blocks."""
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    own = F.array(F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    return members.withColumn("blk", F.explode(F.when(F.col("id") == F.col("hub"), every).otherwise(own))).select("key", "blk", "id", payload)


def links_in_blocks(members: DataFrame, payload: str, block) -> DataFrame:
    """First round: distinct links (a, b) of members with their hub and within blocks."""
    parts = sparkkit.partitions(members.sparkSession)
    rows = _dealt(members, payload).repartition(parts, "key", "blk").sortWithinPartitions("key", "blk", "id")
    return rows.mapInArrow(sparkkit.lean(_in_blocks(block)), "a long, b long").distinct()


def _settle(members: DataFrame, large: DataFrame, n: int, attach, payload: str, checks) -> DataFrame:
    """Components of the links within groups, as (id, component).

    ``members`` are n rows (key, nb, hub, id), ``large`` those of groups of several blocks,
    and ``attach`` adds the payload to such rows by their id.
    """
    block, visit = checks
    comp, _ = sparkkit.written(sparkkit.components(links_in_blocks(attach(members), payload, block)))
    if large.isEmpty():
        return comp
    labels = comp.select(F.col("id").alias("v"), "component")
    rows = large.join(labels, F.col("id") == F.col("v"), "left").select("key", "nb", "hub", "id", F.coalesce("component", "id").alias("label"))
    rows, _ = sparkkit.written(rows, n)
    tops = rows.where("id = hub").groupBy(F.col("key").alias("k")).agg(F.min("label").alias("top"))
    away = F.col("label") != F.col("top")
    left = rows.join(tops, F.col("key") == F.col("k")).withColumn("away", away)
    size = left.where("away").groupBy(F.col("key").alias("k2")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nu"))
    left, _ = sparkkit.written(left.join(size, F.col("key") == F.col("k2")).select("key", "nb", "nu", "id", "label", "away"), n)
    if left.isEmpty():
        return comp
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    to = lambda blk, guests, guest: F.struct(blk.alias("blk"), guests.alias("guests"), F.lit(guest).alias("guest"))
    at_home = F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda i: to(of("nb"), i, 0))
    on_visit = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: to(i, of("nu"), 1))
    dealt = attach(left).withColumn("at", F.explode(F.when(F.col("away"), F.concat(at_home, on_visit)).otherwise(at_home)))
    dealt = dealt.select("key", "at.blk", "at.guests", "at.guest", "label", "id", payload)
    parts = sparkkit.partitions(left.sparkSession)
    more = dealt.repartition(parts, "key", "blk", "guests").sortWithinPartitions("key", "blk", "guests").mapInArrow(sparkkit.lean(_in_visits(visit)), "a long, b long")
    return sparkkit.components(more.unionByName(comp.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, for links of similarity percent / 100 or more."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    most = max_flips(percent)

    chunks = sparkkit.cut(src.mapInArrow(sparkkit.lean(_signatures), _SIG))
    rep = chunks.where("fp1 is not null").groupBy("fp1", "fp2").agg(F.min(F.array_min("ids")).alias("rep"))
    named = sparkkit.cut(chunks.drop("bands", "sketch").join(rep, ["fp1", "fp2"], "left").select("rep", "n", "ids"))
    sigs = chunks.where("fp1 is not null").join(rep, ["fp1", "fp2"]).where(F.array_min("ids") == F.col("rep")).select(F.col("rep").alias("id"), "bands", "sketch")
    sigs = sparkkit.cut(sigs)

    band = sigs.select("id", F.posexplode("bands").alias("band", "k")).select("id", F.xxhash64("band", "k").alias("k1"))
    buckets = band.groupBy(F.col("k1").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last")
    buckets, _ = sparkkit.written(buckets.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), "hub", "n"))
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large, _ = sparkkit.written(buckets.where("nb > 1"))
    within = lambda g: band.join(g, F.col("k1") == F.col("key")).select("key", "nb", "hub", "id")
    families = _settle(within(buckets), within(large), total, lambda rows: rows.join(sigs.select("id", "sketch"), "id"), "sketch", _sketched(most))

    families, _ = sparkkit.written(families)
    lengths = named.where("rep is not null").groupBy(F.col("rep").alias("r")).agg(F.max("n").alias("n"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = families.join(lengths, F.col("id") == F.col("r")).groupBy(F.col("component").alias("key")).agg(blocks.alias("nb"))
    kin = families.join(sizes, F.col("component") == F.col("key")).select("key", "nb", F.col("key").alias("hub"), "id")
    # a table with its real size: where it is small, texts are not shuffled to meet it; else those of its members are
    total = families.count()
    kin, _ = sparkkit.written(kin, total)

    def sets(rows: DataFrame) -> DataFrame:
        names = rows.columns
        types = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        may, _ = sparkkit.sifted(src, F.col("doc_id"), rows.select("id"))
        met = may.join(rows.withColumnRenamed("id", "v"), F.col("doc_id") == F.col("v")).select("text", *[F.col("v").alias("id") if c == "id" else F.col(c) for c in names])
        return met.mapInArrow(sparkkit.lean(_set_rows), f"{types}, set binary").where("length(set) > 0")

    comp = _settle(kin, kin.where("nb > 1"), total, sets, "set", _confirmed(percent, most))

    rows = named.join(comp, named.rep == comp.id, "left").select("n", F.explode("ids").alias("doc_id"), F.coalesce("component", "rep").alias("c"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The input's rows without those whose component has a smaller id; rows of one id all stay or go."""
    name, key = sparkkit.fresh(docs, "gone"), F.col(f"`{id_col}`").cast("long")
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone, _ = sparkkit.written(gone)
    may, stay = sparkkit.sifted(docs, key, gone)
    return stay.union(may.join(gone, key == F.col(name), "left_anti"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(sparkkit.table(spark, sf_dir, "documents"), percent=85)
