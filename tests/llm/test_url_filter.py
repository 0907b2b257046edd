import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import url_filter as U


def direct(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    fits.sort(key=lambda r: len(r[0]))
    return host, path, *(fits[-1] if fits else (None, None))


def test_rules_and_splitting(spark, tmp_path):
    rnd = random.Random(1)
    bits = ["http://", "https://", "HTTP://", "Example.NET", "www.example.net", "example.com", "a.org", "xnet", "net", "/en/", "/de/", "/fr/", "/", "?", "#", "x=1", "é", ".", "://", "\n"]
    urls = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 8))) for _ in range(400)] + [None, "", "http://NET", "http://net/", "http://example.net/en/x", "http://a.example.com/de/?q", "http://z.org/fr/#x", "http://z.org?a/fr/"]
    spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in U.op6_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = direct(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_trees_learn_held_out(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(1500):
        bad = rnd.random() < 0.4
        host = f"{'cheap-pills' if rnd.random() < 0.5 else 'win-' + str(rnd.randrange(10**6))}.{rnd.choice(['xyz', 'com'])}" if bad else f"{rnd.choice(['blog', 'news', 'docs'])}.site{rnd.randrange(20)}.{rnd.choice(['com', 'org'])}"
        path = "/" + "/".join(str(rnd.randrange(10**8)) for _ in range(3)) if bad else "/article/title-of-it"
        rows.append((i, f"http://{host}{path}", None if i % 3 == 0 else int(bad), bad))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, bad int")
    got = {r["id"]: r["verdict"] for r in U.judge(df, rules=(), label_col="bad").collect()}
    assert np.mean([(got[i] == "block") == bad for i, _, lab, bad in rows if lab is None]) > 0.95


def test_scores_equal_a_walk_down_each_tree():
    rnd = np.random.default_rng(3)
    x = rnd.random((400, 5))
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    m = U.fit_trees(x, y, trees=10)
    assert ((m.score(x) > 0) == (y > 0)).mean() > 0.9
    for row in x[:50]:
        s = m.base
        for f, c, v in zip(m.feature, m.limit, m.leaf, strict=True):
            k = 0
            while k < 7:
                k = 2 * k + (2 if row[f[k]] > c[k] else 1)
            s += v[k - 7]
        assert abs(s - m.score(row[None])[0]) < 1e-9


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/", 1), (2, "http://b.com/", None)], "page_id long, url string, bad int")
    assert {r["verdict"] for r in U.judge(df, rules=(), label_col="bad").collect()} == {"block"}
    assert {r["verdict"] for r in U.judge(df.withColumn("bad", F.lit(None).cast("int")), rules=(), label_col="bad").collect()} == {"allow"}
    assert U.judge(df.limit(0)).collect() == []


def test_rule_labels_do_not_leak_by_suffix(spark):
    """Where only rules label, verdicts beyond them do not repeat the address suffix; planted lexical signs are found."""
    rnd = random.Random(4)
    rows = []
    for i in range(1200):
        tld = rnd.choice(["net", "com", "org"])
        bad = tld == "net" or (tld == "com" and i % 3 == 0)
        lang = "de" if tld == "com" and bad else rnd.choice(["en", "fr"])
        tail = "".join(rnd.choice("0123456789") for _ in range(24)) + "?a=1&b=2&c=3" if bad else "plain-words"
        rows.append((i, f"http://w{rnd.randrange(9)}.{'example.com' if tld == 'com' else 'site.' + tld}/{lang}/{tail}"))
    rows += [(2000 + i, f"http://w.other.{t}/xx/{'1234567890' * 2 + '1234?a=1&b=2&c=3' if b else 'plain-words'}") for i, (t, b) in enumerate([(t, b) for t in ("com", "info", "dev") for b in (0, 1)] * 3)]
    got = {r["id"]: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    free = [(i, u) for i, u in rows if got[i]["rule"] is None]
    right = [(got[i]["verdict"] == "block") == ("?a=1" in u) for i, u in free]
    assert len(free) > 100 and np.mean(right) > 0.95


def test_shares_come_from_other_folds(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.one{i}/p", 1.0) for i in range(40)] + [(99, "http://z.one0/p", None)], "id long, url string, label double")
    host, path = U.split_url(F.col("url"))
    got = {r["id"]: r for r in U.with_statistics(df.withColumn("host", host).withColumn("path", path).withColumn("label", F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("label")))).collect()}
    assert all(abs(got[i]["domain_rate"] - 0.5) < 0.03 for i in range(40))
    assert got[99]["suffix_rate"] < 0.49


def test_equal_labelled_rows_and_odd_columns(spark):
    df = spark.createDataFrame([(7, "http://a.net/" + "x" * 50000, "n", "s", 1.0)] * 50 + [(8, None, "n", "s", None)], "page_id long, url string, n string, suffix string, score double")
    assert {(r["id"], r["rule"], r["verdict"]) for r in U.judge(df, sample_rows=3).collect()} == {(7, "net/", "block"), (8, None, "block")}
