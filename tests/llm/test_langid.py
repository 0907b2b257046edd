import random

import numpy as np

from millrace.llm import langid as L


def corpus(rnd, n):
    roots = {"en": "the of and that with tion ing", "de": "der und ich nicht ung keit schaft", "fr": "le les de que eau tion et", "es": "el los de que cion ado mente"}
    out = []
    for i in range(n):
        lang = rnd.choice(list(roots))
        bits = roots[lang].split()
        out.append((i, " ".join(rnd.choice(bits) + rnd.choice(["", "", rnd.choice(bits)]) for _ in range(rnd.randrange(3, 60))), lang, f"h{rnd.randrange(8)}", rnd.choice(["com", lang])))
    return out


SCHEMA = "id long, text string, declared string, host string, suffix string"


def test_held_out_accuracy(spark):
    rnd = random.Random(1)
    rows = corpus(rnd, 800)
    seen = [(i, t, lang if i % 2 else None, h, s) for i, t, lang, h, s in rows]
    got = {r["id"]: r for r in L.identify(spark.createDataFrame(seen, SCHEMA), "id", "text", "declared", "host", "suffix").collect()}
    right = [got[i]["lang"] == lang for i, _, lang, _, _ in rows if not i % 2]
    assert np.mean(right) > 0.97
    assert all(got[i]["kept"] for i, *_ in rows)


def test_fusion_against_direct_bayes(spark):
    rnd = random.Random(2)
    rows = corpus(rnd, 60) + [(900, None, "en", "h1", "com"), (901, "123 !!", None, None, None), (902, "", "xx", "h1", None), (3, "der und", None, "h2", "de")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    langs, logp = L.train(df, "id", "text", "declared")
    assert langs == ["de", "en", "es", "fr"]
    k = len(langs)
    ll, n = [], []
    for _, t, *_ in rows:
        d, off = L.tk.buffers(L.pa.array([t], L.pa.string()))
        bins, _ = L.grams(d, off)
        v = logp[:, bins].astype(np.float32).sum(axis=1, dtype=float) * min(1, L.MAX_GRAMS / max(len(bins), 1))
        ll.append(v - v.max())
        n.append(len(bins))
    p = [np.exp(v) / np.exp(v).sum() * (m > 0) for v, m in zip(ll, n, strict=True)]
    total = sum(p) + 1
    total /= total.sum()
    want = []
    for i, (id_, _, said, host, suffix) in enumerate(rows):
        key = lambda r: (r[4] or "", r[3] or "")
        suf = sum(q for q, r in zip(p, rows, strict=True) if (r[4] or "") == (suffix or ""))
        prior = (suf + total * L.SUFFIX_WEIGHT) / (suf.sum() + L.SUFFIX_WEIGHT)
        own = np.maximum(sum(q for q, r in zip(p, rows, strict=True) if key(r) == key(rows[i])) - p[i], 0)
        prior = (own + prior * L.HOST_WEIGHT) / (own.sum() + L.HOST_WEIGHT)
        like = np.array([1.0 if said not in langs else L.TRUST if x == said else (1 - L.TRUST) / (k - 1) for x in langs])
        post = np.exp(ll[i]) * prior * like
        post /= post.sum()
        if n[i] == 0 and said not in langs:
            want.append((id_, "und", 0.0))
        else:
            want.append((id_, langs[int(post.argmax())], round(float(post.max()), 4)))
    got = [(r["id"], r["lang"], round(r["posterior"], 4)) for r in L.identify(df, "id", "text", "declared", "host", "suffix").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None, "h", "s")], SCHEMA)
    assert [tuple(r)[:3] for r in L.identify(df, "id", "text", "declared").collect()] == [(1, "und", 0.0)]
    assert L.identify(df.limit(0), "id", "text", "declared").collect() == []


def test_pages_and_filter(spark):
    d = "/root/testdata/sf0.001"
    pages = L.langid_pages(spark, d).collect()
    assert len(pages) == spark.read.parquet(f"{d}/pages.parquet").count()
    assert np.mean([r["lang"] == r["declared"] for r in pages]) > 0.9
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "12 34", None, "s", 5), (None, "??", "en", "s", 2), (None, "ok", "en", "s", 2)], docs.schema)
    kept = {r["doc_id"] for r in L.keep_identified(docs.unionByName(odd)).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {None}


def test_rare_and_many_languages_on_a_large_table(spark):
    """Shares far under the sample's, more languages than 64, and ids that do not tell rows apart."""
    rnd = random.Random(6)
    sounds = [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiouy"]
    rnd.shuffle(sounds)
    roots = {f"l{k:02}": [sounds[(7 * k + j * (k + 1)) % len(sounds)] + sounds[(3 * k + j) % len(sounds)] for j in range(4)] for k in range(70)}
    say = lambda x: " ".join(rnd.choice(roots[x]) for _ in range(40))
    rows = [(None if i % 2 else i, say("l00"), "l00", "h", "s") for i in range(6000)]
    rows += [(10_000 + 3 * k + j, say(x), x, f"h{x}", "s") for k, x in enumerate(list(roots)[1:]) for j in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    langs, logp = L.train(df, "id", "text", "declared", sample_rows=40)
    assert langs == sorted(roots) and logp.shape == (70, L.BINS)
    got = {r["id"]: r["lang"] for r in L.identify(df.where("declared <> 'l00' or id < 40"), "id", "text", "declared", "host", "suffix", sample_rows=40).collect()}
    assert all(got[i] == x for i, _, x, *_ in rows if i in got and i is not None)


def test_wrong_declarations_and_strange_texts(spark):
    """Declarations that the text contradicts are overruled; other scripts, noise and unwanted languages go."""
    rnd = random.Random(7)
    truth = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    other = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
    wrong = {i for i, (t, _) in truth.items() if i % 10 == 0 and len(t or "") > 300}
    rows = [(i, t, other[lang] if i in wrong else lang, f"h{i % 7}", "x") for i, (t, lang) in truth.items()]
    noise = lambda signs, n: "".join(rnd.choice(signs) for _ in range(n))
    strange = [(-1, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 8, "en", "h1", "x"), (-2, noise("bcdfghjklmnpqrstvwxz", 300), "fr", "h1", "x"), (-3, "qx" * 200_000, None, "h2", "x")]
    df = spark.createDataFrame(rows + strange, SCHEMA).withColumnRenamed("suffix", "gone").repartition(3)
    got = {r["id"]: r for r in L.identify(df, "id", "text", "declared", "host").collect()}
    assert len(wrong) > 40 and np.mean([got[i]["lang"] == truth[i][1] for i in wrong]) > 0.95
    assert not any(got[i]["kept"] for i, *_ in strange)
    assert np.mean([got[i]["kept"] for i in truth]) > 0.995
    left = L.keep_identified(df, "id", "text", "declared", "host", languages=("en", "de"))
    assert left.columns == df.columns
    assert {r["id"] for r in left.collect()} == {i for i, r in got.items() if r["kept"] and r["lang"] in ("en", "de")}


def test_suffix_of_dotted_hosts(spark):
    rows = [(i, "der und nicht", "de", f"h{i}.x.at", "") for i in range(40)] + [(100 + i, "the of and", "en", f"h{i}.x.uk", "") for i in range(40)]
    rows += [(900, "12", None, "new.at", ""), (901, "zqz", None, "new.at", "")]
    got = {r["id"]: r for r in L.identify(spark.createDataFrame(rows, SCHEMA), "id", "text", "declared", "host").collect()}
    assert got[900]["lang"] == "und" and got[901]["lang"] == "de"


def test_texts_are_not_shuffled_for_few_rejected_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = L.keep_identified(docs, languages=("en",))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["lang"] for r in left.collect()} == {"en"}
