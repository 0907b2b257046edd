import random
import re

import numpy as np

from pyspark.sql import functions as F

from millrace.llm import near_dup, sparkkit
from millrace.llm.near_dup import drop_near_duplicates, max_flips, near_duplicates, odd_sketch, op10_near_duplicates, samples, flips


def shingles(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (d, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    common = {}
    for ks in where.values():
        for i in range(len(ks)):
            for j in range(i):
                common[ks[j], ks[i]] = common.get((ks[j], ks[i]), 0) + 1
    for (i, j), n in common.items():
        (a, s), (b, t) = sets[i], sets[j]
        if a is not None and b is not None and 100 * n >= percent * (len(s) + len(t) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    out = [(d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets]
    return sorted(out, key=str)


def test_estimates_are_close():
    rnd = np.random.default_rng(1)
    worst = []
    for _ in range(200):
        u = rnd.integers(0, 2**63, 1000).astype(np.uint64)
        keep = 919  # about 0.85
        v = np.concatenate([u[:keep], rnd.integers(0, 2**63, 1000 - keep).astype(np.uint64)])
        x, y = (odd_sketch(samples(np.unique(w))).view(np.uint64) for w in (u, v))
        worst.append(int(flips(x, y)))
    assert max(worst) <= max_flips(85)
    assert 35 < np.mean(worst) < 65


def test_random_families(spark):
    rnd = random.Random(2)
    rows = []
    for f in range(25):
        seed = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([3, 8, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 20])):
            w = list(seed)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            rows.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    rnd.shuffle(rows)
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    rows += [(None, rows[0][1]), (0, None), (2, ""), (5, " \n"), (rows[4][0], rows[4][1]), (9999, "w " * 20000), (9998, "W " * 19000)]
    df = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, id string")
    got = sorted([tuple(r) for r in near_duplicates(df.repartition(3), percent=85).collect()], key=str)
    assert got == brute(rows, 85)
    left = {r["doc_id"] for r in drop_near_duplicates(df, percent=85).collect()}
    assert left == {g[0] for g in got if g[3]}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in op10_near_duplicates(spark, d).collect()], key=str)
    assert got == brute(rows, 85)
    assert any(not r[3] for r in got)


def test_chains_over_many_blocks(spark, monkeypatch):
    """Families of many blocks whose members are not all alike to the hub: the second round is needed."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rnd = random.Random(5)
    texts = []
    for n in (40, 25):
        w = [f"w{rnd.randrange(300)}" for _ in range(120)]
        for _ in range(n):
            w = list(w)
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sorted([tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()], key=str)
    assert got == brute(rows, 85)
    assert sum(r[3] for r in got) < 10


def test_links_are_linear(spark, monkeypatch):
    """Distinct links of a large family, before their components, in both stages."""
    seen = []
    plain = sparkkit.components
    monkeypatch.setattr(sparkkit, "components", lambda e: seen.append(e.count()) or plain(e))
    rnd = random.Random(6)
    seed = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(1200):
        w = list(seed)
        w[rnd.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=85).collect()
    assert {r["component_id"] for r in got} == {0}
    assert len(seen) >= 2 and seen[0] < 20 * 1200 and all(n < 3 * 1200 for n in seen[1:])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 1, "x", "y"), (2, "A b c", 2, "x", "y"), (3, "q", 3, "x", "y")], "doc_id long, text string, gone long, _gone string, component string")
    assert {r["doc_id"] for r in drop_near_duplicates(df).collect()} == {1, 3}


def test_texts_without_copies_are_not_shuffled(spark, monkeypatch):
    """Where neither families nor dropped ids are small enough to be broadcast, only their texts move."""
    rnd = random.Random(7)
    texts = [" ".join(str(rnd.randrange(10**9)) for _ in range(1500)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:2])] + [(1000, texts[5] + " more"), (None, texts[6]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = sparkkit.cut(df)
    moved = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        before = moved()
        left = [r["doc_id"] for r in drop_near_duplicates(df).collect()]
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(left, key=str) == sorted([*range(400), None, None], key=str)
    assert moved() - before < sum(map(len, texts)) // 4


def test_sieve_loses_no_id(spark, monkeypatch):
    ids = spark.range(-50, 500, 3).select(F.col("id").alias("some id"))
    rows = spark.createDataFrame([(i, "x") for i in [*range(-100, 1000), None]], "id long, words string")
    for most in (sparkkit.MOST_SIEVE_BITS, 64):
        monkeypatch.setattr(sparkkit, "MOST_SIEVE_BITS", most)
        may, none = sparkkit.sifted(rows, F.col("id"), ids)
        may, none = [r["id"] for r in may.collect()], [r["id"] for r in none.collect()]
        assert sorted([*may, *none], key=str) == sorted([*range(-100, 1000), None], key=str)
        assert set(range(-50, 500, 3)) <= set(may) and (most == 64 or len(may) < 300)
    may, none = sparkkit.sifted(rows, F.col("id"), ids.limit(0))
    assert not may.count() and none.count() == 1101


def test_small_rounds_write_few_files(spark, monkeypatch):
    files, plain = [], sparkkit.written

    def written(df, *rows):
        out = plain(df, *rows)
        files.append(out[0].inputFiles())
        return out

    monkeypatch.setattr(sparkkit, "written", written)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(400) if i % 100], "a long, b long")
        got = {r["id"]: r["component"] for r in sparkkit.components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: (i - 1) // 100 * 100 + 1 for i in range(1, 401)}
    assert len(files) > 4 and all(len(f) == 1 for f in files[1:])


def test_freed_memory_goes_back():
    held = []

    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024

    def work(batches):
        for b in batches:
            blocks = [np.ones(12000) for _ in range(2000)]
            held.append([np.ones(100) for _ in range(10)])  # above the blocks
            assert resident() > before + 100
            del blocks
            yield b

    before = resident()
    assert list(sparkkit.lean(work)(iter([1]))) == [1]
    assert resident() < before + 60
