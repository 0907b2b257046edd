import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm.packing import assign, op7_pack_sequences, pack_documents
from millrace.llm.tokens import UnitTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: b"".join(i.to_bytes(4, "little") for i in [*t.encode(x or "", add_special_tokens=False).ids, 1])


def test_units_equal_whole_texts(plain):
    rnd = random.Random(3)
    bits = ["the", "ö", "don't", "12", "!?", " ", "  ", "\n", "\n\n", "\t", " ", " ", "<|endoftext|>", "x" * 70, "日本", "'s", "\r", "a b"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(30))) for _ in range(500)] + [None, "", " ", "\n"]
    assert UnitTokenizer(PATH).encode(texts) == [plain(t) for t in texts]


def test_added_tokens_as_by_default(plain):
    text = "a <|endoftext|> b"
    assert plain(text) == UnitTokenizer(PATH).encode([text])[0]
    assert (50256).to_bytes(4, "little") in plain(text)


def test_assign_fills_every_room():
    rnd = random.Random(1)
    for _ in range(30):
        lengths = [rnd.randrange(1, 300) for _ in range(rnd.randrange(0, 60))]
        pieces, n = assign(lengths, 64)
        seqs = {}
        for i, start, length, s, off in pieces:
            seqs.setdefault(s, []).append((off, length))
        assert sorted(seqs) == list(range(n))
        for s in seqs.values():
            end = 0
            for off, length in sorted(s):
                assert off == end
                end += length
            assert end <= 64 and (end & (end - 1)) == 0
        for i, size in enumerate(lengths):
            end = 0
            for _, start, length, _, _ in sorted(p for p in pieces if p[0] == i):
                assert start == end
                end += length
            assert end == size


def test_round_trip(spark, plain):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = sorted(op7_pack_sequences(spark, d).collect())
    at, seqs = {}, {}
    for r in rows:
        ids = plain(docs[r["doc_id"]])
        assert r["doc_tokens"] * 4 == len(ids)
        assert r["start"] == at.get(r["doc_id"], 0)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * at[r["doc_id"]]])
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: v * 4 for k, v in at.items()} == {k: len(plain(v)) for k, v in docs.items()}
    for s in seqs.values():
        end = 0
        for off, length in sorted(s):
            assert off == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "x " * 6000, 4)], "doc_id long, text string, start int")
    rows = pack_documents(df).collect()
    long = next(r["doc_tokens"] for r in rows if r["doc_id"] == 2)
    assert sum(r["length"] for r in rows) == 1 + 1 + 3 + long
    assert {r["doc_id"] for r in rows} == {1, 2, None}
    assert pack_documents(df.limit(0)).collect() == []


def test_units_at_every_cut(plain):
    """Signs after letters of any script, odd spaces at and off the cuts, slices of all lengths; an Arrow slice does as a list."""
    rnd = random.Random(4)
    signs = "aZé9'’!,.-–(\"_ß日́  \u0085​\x1f\t\r😀"
    texts = ["".join(rnd.choice(signs + " " * (k % 5) + "\n" * (k % 3)) for _ in range(rnd.randrange(40))) for k in range(3000)]
    texts += ["it's 'tis x'LL,y", "\n", " a", "a ", "a\n\nb", "x" * 100_000 + " y", None, "", "a<|endoftext|>b"]
    want = [plain(t) for t in texts]
    tok = UnitTokenizer(PATH)
    assert tok.encode(texts) == want
    assert tok.encode(pa.array(["z z", *texts], pa.string()).slice(1)) == want
    assert [tok.encode([t])[0] for t in texts[-300:]] == want[-300:]


def test_words_do_not_stay(plain):
    """A worker outlives its tasks, so what it holds must not grow with the words it saw."""
    tok = UnitTokenizer(PATH)
    at = lambda: sum(len(x) for v in vars(tok).values() for x in (v if isinstance(v, tuple) else [v]) if isinstance(x, dict))
    before = at()
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(400)]
    assert tok.encode(texts) == [plain(t) for t in texts]
    assert at() == before
