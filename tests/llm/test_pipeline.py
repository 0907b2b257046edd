import corpus_pipeline as P
from test_decontaminate import brute as leaks
from test_near_dup import brute as near
from test_secrets import base

from millrace.llm import decontaminate as D

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(-3, None, None, "s", 0), (-2, "12 34", None, "s", 5), (-1, "a token = 'abcdefghijkl0123' here it is", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    cols = docs.columns
    seen = [docs.collect()]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == cols
        seen.append(docs.collect())
    start, lang, dup, clean, secret, pieces = seen
    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in lang} == {-3, -2}
    kept = {d for d, _, _, k in near([(r["doc_id"], r["text"]) for r in lang], P.SIMILARITY) if k}
    assert {r["doc_id"] for r in dup} == kept and len(dup) < len(lang)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in dup], items, D.THRESHOLD, D.OVERLAP)}
    assert {r["doc_id"] for r in clean} == kept - bad and bad
    before = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in secret} == before.keys()
    for r in secret:
        if sum(base(before[r["doc_id"]])[:3]):
            assert r["text"] != before[r["doc_id"]] and sum(base(r["text"])[:3]) == 0
        elif r["text"] != before[r["doc_id"]]:
            assert "[SECRET]" in r["text"]
        assert r["n_chars"] == len(r["text"]) or r["text"] == before[r["doc_id"]]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in secret}


def test_run(spark):
    rows = P.run(spark, DIR).collect()
    assert rows and sum(r["length"] for r in rows) > 0


def test_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
