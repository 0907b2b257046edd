import hashlib
import random

from millrace.llm.substring_dedup import op4_substring_dedup, substring_dedup


def brute(rows, width):
    import re

    first = {}
    words = {}
    for k, (d, t) in enumerate(rows):
        words[k] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(words[k]) - width + 1):
            w = tuple(words[k][i : i + width])
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for k, (d, _) in enumerate(rows):
        gone = set()
        for i in range(len(words[k]) - width + 1):
            if d is not None and first[tuple(words[k][i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(words[k]) if i not in gone)
        out.append((d, len(words[k]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, width):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, bucket string")
    got = substring_dedup(df.repartition(3), width=width, with_text=False).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, width)


def test_random_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 60))) for _ in range(120)]
    texts += [texts[3] + "\n" + texts[9], "é ü x " * 30, "w" * 5000 + " " + texts[5], None, "", " \t\n"]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(5, texts[7]), (5, texts[7]), (None, texts[3])]
    check(spark, rows, 4)
    check(spark, rows, 13)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in op4_substring_dedup(spark, d).collect()], key=str)
    assert got == brute(rows, 13)
    assert any(r[2] for r in got)


def test_one_id_with_texts_of_different_lengths(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abcdefghijkl") + str(rnd.randrange(50)) for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = [(1, " ".join(shared)), (7, text(40) + " " + shared[0]), (7, text(90)), (7, text(3)), (7, ""), (7, None), (7, shared[1] + " " + text(20))]
    rows += [(8, shared[2] + " " + text(9)), (8, text(39)), (8, text(9) + " " + shared[2])]
    check(spark, rows, 4)
    check(spark, rows, 13)
