"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: hashed byte 3-grams of the letters, multinomial naive Bayes.  The languages
  are all those of labelled rows with letters, by a grouped count over the whole table.
  Counts come from a hash sample of each language's rows (all, if few; one at least),
  SAMPLE_ROWS by all languages together but LANGUAGE_ROWS by each, summed by language
  and bin in Spark; a row counts for TRAIN_GRAMS grams at most.  A long text speaks with the weight of MAX_GRAMS grams.
* Declaration: the declared (markup) language is right with probability TRUST.
* Host: what the *other* rows of the host are, by text, smoothed toward the address
  suffix, which is smoothed toward the whole corpus.  These sums are grouped
  aggregations over all rows; a row's own share is taken out of its host's.
* Address suffix: through that hierarchy, and alone where a host has one row.  Without a
  column of its own it is a host's last label, if the host has a dot.

The posterior over the languages seen in the labels is the normalised product.  ``fit`` is
the probability that the text is in its best language at all and not drawn evenly from all
3-grams, with prior odds of BACKGROUND for the latter: texts in a language without labels,
or of noise, fall to 0.  A row is kept unless its posterior is under MIN_POSTERIOR, its fit
under MIN_FIT, or it has neither letters nor a known declaration.

Scale: texts are read three times (the count, the sample's and the scoring scan); memory
and work grow with the number of languages; what is scored is
checkpointed without texts.  Texts are shuffled only where the list of languages, or of
rejected ids, is too large to be broadcast.  Host sums are pre-aggregated before the shuffle and joined
as a table of its own, so adaptive execution broadcasts it if small or splits hot hosts.

Defined cases: null or empty texts, and texts without letters, give no text evidence; a
null or unknown declaration is no evidence; null hosts and suffixes form one group each.
Every input row gives one row.  Without any label the result is 'und', not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit
from . import textkit as tk

SAMPLE_ROWS, LANGUAGE_ROWS, BINS = 4000, 500, 1 << 14
MAX_GRAMS, TRUST, MIN_POSTERIOR = 60.0, 0.9, 0.5
BACKGROUND, MIN_FIT = 1e-3, 0.5
#: Bytes of text that are scored at a time: a gram takes some 50 bytes meanwhile.
SLICE_BYTES = 1 << 18
#: Weight of a row in training, in grams.
TRAIN_GRAMS = 2000
#: Pseudo-counts of the prior above: corpus for a suffix, suffix for a host.
SUFFIX_WEIGHT, HOST_WEIGHT = 10.0, 5.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte 3-grams that hold a letter, and each one's row."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[data].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    ok = (b[:-2] != 32) | (b[1:-1] != 32)
    inner = np.ones(len(data) + 2, bool)
    inner[np.maximum(off[1:] - 1, 0)] = False
    inner[np.maximum(off[1:] - 2, 0)] = False
    at = np.flatnonzero(ok & inner[: len(code)])
    bins = ((code[at] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    return bins, np.searchsorted(off, at, side="right") - 1


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        data, off = tk.buffers(batch.column(0))
        langs = batch.column(1).to_pylist()
        for a, z in tk.slices(data, off):
            bins, rows = grams(data[off[a] : off[z]], off[a : z + 1] - off[a])
            codes = {x: i for i, x in enumerate(dict.fromkeys(langs[a:z]))}
            of = np.array([codes[x] for x in langs[a:z]])
            share = np.minimum(1.0, TRAIN_GRAMS / np.maximum(np.bincount(rows, minlength=z - a), 1))
            m = np.bincount(of[rows] * BINS + bins, share[rows], minlength=len(codes) * BINS).reshape(len(codes), BINS)
            for x, i in codes.items():
                sums[x] = sums.get(x, 0) + m[i]
    for x, v in sums.items():
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(v[at])], names=["lang", "bin", "n"])


def train(df: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """All labelled languages and their log-likelihoods per bin, from a bounded hash sample of each one's rows."""
    src = df.select(F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("lang"), F.col(id_col).alias("id")).where("lang is not null")
    # the texts that have a gram
    src = src.where((F.octet_length("t") >= 3) & F.col("t").rlike(r"(?s)[A-Za-z].|[^\x00-\x7F]")).withColumn("h", F.xxhash64("id", "t"))
    all_rows = src.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("h")).orderBy("lang").collect()
    if not all_rows:
        return [], np.full((0, BINS), 0.5)
    langs = [r["lang"] for r in all_rows]
    quota = max(sample_rows // len(langs), LANGUAGE_ROWS)
    rates = [(r["lang"], every, r["h"] % every) for r in all_rows for every in [max(1, r["n"] // quota)]]
    part = src
    if any(every > 1 for _, every, _ in rates):
        # from Arrow, as only such a local table has a size of its own: it is broadcast while it is small
        cols = [pa.array(c, t) for c, t in zip(zip(*rates, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
        by = df.sparkSession.createDataFrame(pa.table(cols, names=["lang2", "every", "rest"]))
        part = src.join(by, F.col("lang") == F.col("lang2")).where(F.pmod("h", "every") == F.col("rest"))
    counts = part.select("t", "lang").mapInArrow(_gram_counts, "lang string, bin long, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    m = np.full((len(langs), BINS), 0.5)
    places = {x: i for i, x in enumerate(langs)}
    for b in counts.to_batches():
        of = np.array([places[x] for x in b.column(0).to_pylist()], np.int64)
        np.add.at(m, (of, np.asarray(b.column(1))), np.asarray(b.column(2)))
    return langs, np.log(m / m.sum(axis=1, keepdims=True))


def _score(logp: np.ndarray):
    table = np.ascontiguousarray(logp.T.astype(np.float32))
    n_lang = table.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.buffers(batch.column(0))
            sums, n = np.zeros((batch.num_rows, n_lang)), np.zeros(batch.num_rows)
            for a, z in tk.slices(data, off, SLICE_BYTES):
                bins, rows = grams(data[off[a] : off[z]], off[a : z + 1] - off[a])
                n[a:z] = np.bincount(rows, minlength=z - a)
                for k in range(n_lang):
                    sums[a:z, k] = np.bincount(rows, table[bins, k], minlength=z - a)
            weight = np.minimum(1.0, MAX_GRAMS / np.maximum(n, 1))
            sums *= weight[:, None]
            over = sums.max(axis=1) + weight * n * np.log(BINS)
            fit = 1 / (1 + BACKGROUND * np.exp(np.minimum(-over, 500.0)))
            sums -= sums.max(axis=1, keepdims=True)
            ll = pa.ListArray.from_arrays(np.arange(0, batch.num_rows * n_lang + 1, n_lang, dtype=np.int32), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n.astype(np.int64)), pa.array(fit), ll], names=[*batch.schema.names[1:], "grams", "fit", "ll"])

    return run


def _normal(arr: Column) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda t, v: t + v)
    return F.transform(arr, lambda v: v / total)


def identify(df: DataFrame, id_col: str, text_col: str, declared_col: str | None = None, host_col: str | None = None, suffix_col: str | None = None, label_col: str | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: id, lang, posterior, text_lang, declared, n_grams, fit (1 without letters), kept."""
    langs, logp = train(df, id_col, text_col, label_col or declared_col, sample_rows)
    col = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    if not langs:
        none = F.lit(None).cast("string")
        return df.select(F.col(id_col).alias("id"), F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), none.alias("text_lang"), col(declared_col).alias("declared"), F.lit(0).cast("long").alias("n_grams"), F.lit(1.0).alias("fit"), F.lit(False).alias("kept"))
    host = F.coalesce(col(host_col), F.lit(""))
    suffix = F.coalesce(col(suffix_col), F.lit("")) if suffix_col else F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1)).otherwise("")
    src = df.select(col(text_col).alias("text"), F.col(id_col).alias("id"), col(declared_col).alias("declared"), host.alias("host"), suffix.alias("suffix"))
    schema = f"id {dict(df.dtypes)[id_col]}, declared string, host string, suffix string, grams long, fit double, ll array<double>"
    scored = src.mapInArrow(_score(logp), schema)
    scored = scored.withColumn("p", _normal(F.transform("ll", lambda v: F.exp(v))))
    scored = sparkkit.cut(scored)
    k = len(langs)
    p = [F.sum(F.when(F.col("grams") > 0, F.col("p")[i]).otherwise(0.0)).alias(f"p{i}") for i in range(k)]
    hosts = scored.groupBy("suffix", "host").agg(*p)
    up = lambda keys: hosts.groupBy(*keys).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)])
    total = up([]).first()
    corpus = np.array([total[i] or 0.0 for i in range(k)]) + 1.0
    corpus = (corpus / corpus.sum()).tolist()
    vec = lambda: F.array(*[F.col(f"p{i}") for i in range(k)])
    blend = lambda sums, prior, w: F.zip_with(sums, prior, lambda s, q: (s + q * w) / (F.aggregate(sums, F.lit(0.0), lambda t, v: t + v) + w))
    suffixes = up(["suffix"]).select(F.col("suffix").alias("s2"), blend(vec(), F.array(*map(F.lit, corpus)), SUFFIX_WEIGHT).alias("prior"))
    hosts = sparkkit.cut(hosts.join(suffixes, F.col("suffix") == F.col("s2")).select(F.col("suffix").alias("s1"), F.col("host").alias("h1"), vec().alias("sums"), "prior"))
    both = scored.join(hosts, (F.col("suffix") == F.col("s1")) & (F.col("host") == F.col("h1")), "left")
    own = F.when(F.col("grams") > 0, F.col("p")).otherwise(F.array_repeat(F.lit(0.0), k))
    others = F.zip_with("sums", own, lambda s, v: F.greatest(s - v, F.lit(0.0)))
    both = both.withColumn("prior", blend(others, F.col("prior"), HOST_WEIGHT))
    names = F.array(*map(F.lit, langs))
    known = F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False))
    wrong = (1 - TRUST) / max(k - 1, 1)
    said = F.when(known, F.transform(names, lambda x: F.when(x == F.col("declared"), F.lit(TRUST)).otherwise(F.lit(wrong)))).otherwise(F.array_repeat(F.lit(1.0), k))
    score = F.zip_with(F.zip_with("ll", "prior", lambda a, b: F.exp(a) * b), said, lambda a, b: a * b)
    both = both.withColumn("post", _normal(score))
    # from rounding of sums only: ties go to the language that sorts first
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    ok = (F.col("grams") > 0) | known
    out = both.select(
        "id",
        F.when(ok, best(F.col("post"))).otherwise("und").alias("lang"),
        F.when(ok, F.array_max("post")).otherwise(0.0).alias("posterior"),
        F.when(F.col("grams") > 0, best(F.col("ll"))).alias("text_lang"),
        "declared",
        F.col("grams").alias("n_grams"),
        F.when(F.col("grams") > 0, F.col("fit")).otherwise(1.0).alias("fit"),
    )
    return out.withColumn("kept", F.coalesce((F.col("posterior") >= MIN_POSTERIOR) & (F.col("fit") >= MIN_FIT), F.lit(False)))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", languages: tuple[str, ...] | None = None) -> DataFrame:
    """The input's rows without those that identification rejects, or finds in none of ``languages``.

    An id's rows go only if each of them goes; a row without an id goes if its text has no letter.
    """
    gone, got = sparkkit.fresh(docs, "gone"), identify(docs, id_col, text_col, declared_col, host_col)
    wanted = F.col("kept") & F.col("lang").isin(*languages) if languages is not None else F.col("kept")
    rejected = got.groupBy("id").agg(F.bool_or(wanted).alias("any")).where("id is not null and not any").select(F.col("id").alias(gone))
    # as a table it has its real size, so that texts are shuffled only if many ids go
    rejected, _ = sparkkit.written(rejected)
    letters = F.coalesce(F.col(text_col).cast("string").rlike("[^\\x00-@\\[-`{-\\x7F]"), F.lit(False))
    return docs.where(F.col(id_col).isNotNull() | letters).join(rejected, F.col(id_col) == F.col(gone), "left_anti")


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, text, declared, host, suffix) of raw pages, by expressions alone."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    declared = F.lower(F.regexp_extract(h, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style|title)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), bare.alias("text"), F.when(declared != "", declared).alias("declared"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = identify(sparkkit.table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return got.withColumnRenamed("id", "doc_id").withColumn("posterior", F.round("posterior", 6)).withColumn("fit", F.round("fit", 6))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = identify(page_evidence(sparkkit.table(spark, sf_dir, "pages")), "page_id", "text", "declared", "host", "suffix")
    return got.withColumnRenamed("id", "page_id").withColumn("posterior", F.round("posterior", 6)).withColumn("fit", F.round("fit", 6))
