import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ann


def brute(rows, query, k):
    by = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        by.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in by:
        if query(q):
            best = {}
            for own in by[q]:
                for i, vs in by.items():
                    if i != q:
                        best[i] = min(best.get(i, math.inf), *[math.sqrt(((own - x) ** 2).sum()) for x in vs])
            out[q] = sorted((s, i) for i, s in best.items())[:k]
    return out


def recall(got, want):
    hit = total = 0
    for q, best in want.items():
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(best)
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        last = best[-1][0] if best else 0
        hit += sum(r["score"] <= last + 1e-9 for r in rows)
        total += len(best)
    return hit / max(total, 1)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = ann.op1_nearest_neighbours(spark, d).collect()
    assert recall(got, brute(rows, lambda q: q % 100 == 0, 10)) >= 0.9


def test_recall_on_more_vectors(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = ann.op1_nearest_neighbours(spark, d).collect()
    assert recall(got, brute(rows, lambda q: q % 100 == 0, 10)) >= 0.9


def test_odd_rows_exactly(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.0, 0.5, 2.0]) for _ in range(5)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(40)] + [(0, rows[0][1]), (7, [9.0] * 5), (None, [1.0] * 5), (300, None), (400, [0.0] * 5), (500, [1.0, None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 5), (700, [float("inf")] * 5), (800, [])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    got = ann.nearest(df.repartition(3), F.col("id") % 20 == 0, k=10).collect()
    want = brute(rows, lambda q: q % 20 == 0, 10)
    assert {(r["query_id"], r["rank"]): (round(r["score"], 9), r["vec_id"]) for r in got} == {(q, n + 1): (round(s, 9), i) for q, b in want.items() for n, (s, i) in enumerate(b)}
    small = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert len(ann.nearest(small, F.col("id") % 20 == 0).collect()) == 4
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_cells_come_in_order():
    rnd = np.random.default_rng(3)
    d1, d2 = rnd.random(9), rnd.random(7)
    counts = rnd.integers(0, 3, (9, 7))
    cells = ann.visit(d1, d2, counts, 1e9)
    total = (d1[:, None] + d2).ravel()
    assert sorted(cells) == np.flatnonzero(counts.ravel()).tolist()
    assert all(total[a] <= total[b] + 1e-12 for a, b in zip(cells, cells[1:], strict=False))


def test_cells_are_dealt_evenly_and_hot_ones_split(spark):
    counts = np.array([[3, 0, 4], [50, 2, 2], [1, 1, 25]])
    first, ways = ann.deal_cells(counts, 10)
    held = {}
    for c, n in enumerate(counts.ravel()):
        assert ways[c] == max(1, -(-n // 10))
        for g in range(first[c], first[c] + ways[c]):
            held[g] = held.get(g, 0) + n / ways[c]
    assert max(held.values()) <= 10 and sorted(held) == list(range(max(held) + 1))


def test_hot_cell_over_many_groups(spark, monkeypatch):
    """A third of all vectors lie in one cell; it is split, and results equal brute force as all cells are visited."""
    monkeypatch.setattr(ann, "GROUP_VECTORS", 25)
    rnd = np.random.default_rng(8)
    x = np.r_[rnd.normal(size=(300, 6)), rnd.normal(size=(150, 6)) * 1e-3 + 5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, share=1.0)
    want = brute(rows, lambda q: q % 50 == 0, 10)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == sorted((q, n + 1, i) for q, b in want.items() for n, (_, i) in enumerate(b))
