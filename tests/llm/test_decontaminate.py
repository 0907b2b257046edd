import random
import re

import numpy as np

from millrace.llm import decontaminate as D

WORD = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+")


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]


def brute(docs, items, threshold, overlap):
    parts = {i: tuple(map(words, D.split_item(t))) for i, t in items if i is not None}
    whole = {i: (q if D.split_item(t)[0] == D.split_item(t)[1] else q + a) for (i, t), (q, a) in zip([x for x in items if x[0] is not None], parts.values(), strict=True)}
    whole = {i: w for i, w in whole.items() if w}
    n, mean = len(whole), np.mean([len(w) for w in whole.values()])
    df = {}
    for w in whole.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1

    def weight(x, w):
        tf = w.count(x)
        return np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * len(w) / mean))

    size = max(D.MIN_PASSAGE, 2 * max(map(len, whole.values())))
    out = {}

    def covered(part, text):
        k = min(D.NGRAM, len(part))
        grams = {tuple(text[i : i + k]) for i in range(len(text) - k + 1)}
        hit = set()
        for i in range(len(part) - k + 1):
            if tuple(part[i : i + k]) in grams:
                hit |= set(range(i, i + k))
        return len(hit) / len(part)

    for d, t in docs:
        w = words(t)
        for lo in range(0, max(len(w), 1), size // 2):
            p = w[lo : lo + size]
            have = set(p)
            for i, it in whole.items():
                total = sum(weight(x, it) for x in set(it))
                score = sum(weight(x, it) for x in set(it) & have) / total
                if score >= threshold - 1e-9 and all(covered(x, p) >= overlap for x in parts[i]):
                    out[d, i] = max(out.get((d, i), 0), round(score, 9))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"t{i}" for i in range(300)] + ["the", "of", "and", "Été"] * 20
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, text(rnd.randrange(4, 50)) + rnd.choice([". Answer is " + text(3), ""])) for i in range(60)] + [(100, None), (101, ""), (None, "x y"), (102, "...")]
    docs = []
    for d in range(150):
        t = text(rnd.randrange(0, 400))
        if d % 3 == 0:
            w = items[rnd.randrange(60)][1].split()
            if d % 2:
                w = w[: rnd.randrange(1, len(w) + 1)]
            t += "\n" + " ".join(w).upper().replace("É", "É") + " " + text(rnd.randrange(100))
        docs.append((d, t))
    docs += [(500, None), (501, ""), (None, items[3][1]), (0, items[5][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in D.contaminated(df, bench).collect():
        k = (r["doc_id"], r["item_id"])
        got[k] = max(got.get(k, 0), round(r["score"], 9))
    assert got == brute(docs, items, D.THRESHOLD, D.OVERLAP)
    assert len(got) >= 15
    kept = D.drop_contaminated(df, bench).collect()
    want = [d for d in docs if not brute([d], items, D.THRESHOLD, D.OVERLAP)]
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted(want, key=str)
    assert kept[0].asDict().keys() == {"doc_id", "text", "item_id"}


def test_shards_and_empty(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    one = sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in D.contaminated(docs, items).collect())
    monkeypatch.setattr(D, "SHARD_BYTES", 3000)
    many = sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in D.contaminated(docs, items).collect())
    assert one == many and one
    assert D.contaminated(docs.limit(0), items).collect() == []
    assert D.contaminated(docs, items.limit(0)).collect() == []


def test_wand_equals_full_scores():
    rnd = random.Random(8)
    rows = [(i, " ".join(f"a{rnd.randrange(80)}" for _ in range(20)), f"b{i % 7}") for i in range(100)]
    ix = D.build_index(rows, 21, 100, 21.0)
    for _ in range(40):
        terms = np.array(sorted(rnd.sample(range(len(ix.terms)), 40)))
        full = np.zeros(100)
        for t in terms:
            full[ix.items[ix.start[t] : ix.start[t + 1]]] += ix.impact[ix.start[t] : ix.start[t + 1]]
        got = dict(D.wand(ix, terms, 0, 100, 0.5))
        assert sorted(got) == np.flatnonzero(full >= 0.5 - 1e-9).tolist()
        assert all(abs(full[k] - v) < 1e-9 for k, v in got.items())


def test_items_without_an_id_count(spark, monkeypatch):
    text = "Which of these rivers runs through the old capital of the north? The long grey river that rises in the hills."
    items = spark.createDataFrame([(None, text), (4, "What is two plus two in the usual way of counting things? It is four, as all of us know.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + text + " and more"), (2, "clean words")], "doc_id long, text string")
    for size in (1 << 20, 50):
        monkeypatch.setattr(D, "SHARD_BYTES", size)
        assert [(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()] == [(1, None)]
        assert [r["doc_id"] for r in D.drop_contaminated(docs, items).collect()] == [2]


def test_very_long_text_and_ties(spark):
    """An item deep inside a text of some 2 MB; equal rows and equal items are reported each."""
    text = "Which of these rivers runs through the old capital of the north? The long grey river that rises in the hills."
    long = "filler words of no item " * 90_000
    items = spark.createDataFrame([(1, text), (2, text)], "item_id long, text string")
    docs = spark.createDataFrame([(7, long + text + " " + long), (7, text), (7, text), (8, long)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect())
    assert got == [(7, 1)] * 3 + [(7, 2)] * 3
