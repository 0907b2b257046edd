import itertools
import random

from millrace.llm import licenses as L


def test_rising_is_longest():
    rnd = random.Random(1)
    for _ in range(100):
        b = rnd.sample(range(9), 7)
        pairs = list(enumerate(b))
        got = L.rising(pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        best = max(k for k in range(1, 8) for c in itertools.combinations(b, k) if list(c) == sorted(c))
        assert len(got) == best


def patience(a, b):
    """Direct recursion on slices: heads, tails, anchors by trying all rising subsets' lengths."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + patience(a[:-1], b[:-1])
    anchors = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 and b.count(w) == 1]
    anchors = L.rising(sorted(anchors))
    if not anchors:
        return 0
    n, (i0, j0) = 0, (0, 0)
    for i, j in [*anchors, (len(a), len(b))]:
        n += patience(a[i0:i], b[j0:j])
        i0, j0 = i + 1, j + 1
    return n + len(anchors)


def test_alignment_against_recursion():
    rnd = random.Random(2)
    for _ in range(200):
        a = [rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(0, 14))]
        b = [rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(0, 14))]
        got = L.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(got) == patience(a, b)


def test_planted(spark):
    rnd = random.Random(3)
    prose = lambda n: " ".join(rnd.choice("the of software to and copy free ton bar qux zed any".split()) for _ in range(n))
    rows, want = [], set()
    for i, (name, t) in enumerate(L.TEMPLATES.items()):
        w = t.split()
        if len(w) > 15:
            w[7] = "changed"
        rows.append((i, prose(rnd.randrange(300)) + "\n" + " ".join(w).upper() + "\n" + prose(50), 7.0))
        want.add((i, name))
    rows += [(100 + i, prose(500), 0.0) for i in range(30)] + [(200, None, 0.0), (201, "", 0.0), (None, L.TEMPLATES["MIT"], 0.0), (0, L.TEMPLATES["ISC"], 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage double")
    got = {(r["doc_id"], r["license"]) for r in L.find_licenses(df).collect()}
    assert want | {(None, "MIT"), (0, "ISC")} <= got
    assert all(d is None or d < 100 for d, _ in got)
    assert L.find_licenses(df.limit(0)).collect() == []


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {(r["doc_id"], r["license"]) for r in L.op8_license_scan(spark, d).collect()}
    for name in ("Apache-2.0", "CC-BY-NC-4.0"):
        want = {i for i, t in docs.items() if L.TEMPLATES[name] in t}
        assert want and want <= {i for i, n in got if n == name}
    assert all("icense" in docs[i] or "CC" in docs[i] for i, _ in got)


LINES = {
    "Licensed under the Apache License, Version 2.0.": {"Apache-2.0"},
    "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
    "Released under the MIT License.": {"MIT-notice", "MIT-release"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-short", "GPL-3.0-short"},
    "All rights reserved.": {"All-rights-reserved-short"},
}


def test_lines_of_the_table_against_search(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = {(i, name) for i, t in docs.items() for line, names in LINES.items() if line in t for name in names}
    assert {name for _, name in want} == set().union(*LINES.values())
    assert {(r["doc_id"], r["license"]) for r in L.op8_license_scan(spark, d).collect()} == want


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_naming_words_against_brute_force(spark):
    """Frames with other licences' names: every stretch is tried, with the longest common subsequence."""
    rnd = random.Random(4)
    names = {"MIT-notice": "mit", "GPL-short": "gnu general public license", "LGPL-short": "gnu lesser general public license", "CC-BY-4.0": "cc by 4 0", "CC-BY-NC-4.0": "cc by nc 4 0"}
    heads = ["licensed under the", "released under the", "used under", "x y"]
    tails = ["mit license", "apache license", "gnu general public license version 2", "gnu lesser general public license", "cc by 4 0", "cc by nc 4 0", "zlib license"]
    texts = {i: " ".join(f"{rnd.choice(heads)} {rnd.choice(tails)} pad{i} q r s t u v w x y z k l m n o p" for _ in range(rnd.randrange(1, 4))) for i in range(60)}
    want = set()
    for i, t in texts.items():
        w = t.split()
        for name, phrase in names.items():
            p, tpl = phrase.split(), L.TEMPLATES[name].lower().replace("-", " ").replace(".", " ").split()
            u = next(k for k in range(len(tpl)) if tpl[k : k + len(p)] == p)
            for j in range(len(w)):
                if w[j : j + len(p)] == p and common(tpl[:u], w[max(0, j - 12) : j]) + len(p) + common(tpl[u + len(p) :], w[j + len(p) :][:12]) >= 0.8 * len(tpl):
                    want.add((i, name))
    got = {(r["doc_id"], r["license"]) for r in L.find_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {x for x in got if x[1] in names} == want
    assert {n for _, n in want} == set(names)


def test_versions_are_told_apart(spark):
    texts = ["Licensed under the Apache License, Version 1.0", "Licensed under the Apache License 2.0", L.TEMPLATES["GPL-2.0-notice"], L.TEMPLATES["AGPL-3.0-notice"], "Licensed under the GNU General Public License, version 2. Chapter three of version 3", "Licensed under the"]
    got = [set() for _ in texts]
    for r in L.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["license"])
    assert got == [set(), {"Apache-2.0"}, {"GPL-2.0-notice", "GPL-short"}, {"AGPL-3.0-notice", "AGPL-short"}, {"GPL-short", "GPL-2.0-short"}, set()]


def test_very_long_text(spark):
    long = "words that say the least of it and more " * 60_000
    df = spark.createDataFrame([(1, long + L.TEMPLATES["MIT"] + " " + long), (2, long), (3, "word" * 500_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in L.find_licenses(df).collect()] == [(1, "MIT", 1.0)]
