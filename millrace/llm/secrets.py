"""Secret scanning with DataFrame and SQL expressions only.

Base kinds are found by patterns.  On top of them a randomness test battery looks at
every other unbroken run of 20 or more characters of an encoding alphabet:

* the encoding is inferred from the signs that occur, the smallest that holds them all:
  hex (16 signs), base32 (32) and base36 (36) in either case, base62 or base64/base64url
  (64).  A random string of a larger alphabet that by chance stays within a smaller one is
  uniform over the smaller one.  Runs of digits alone are numbers, not secrets;
* chi-squared uniformity over the alphabet, a runs test about the alphabet's middle
  and a lag-1 serial correlation test must each be consistent with random signs
  (p >= 0.001 each, so few random secrets of these alphabets are lost by them); in base32
  and base36, letters and digits must also take turns as often as random signs do, which
  names with dates and numbers do not;
* against the opposite hypothesis, ordinary text, the squared counts behind chi-squared
  and the runs of sign classes give z values whose spread depends on the length; their
  joint p-value is judged by Benjamini-Hochberg at rate 0.01 within each stratum of encoding and length over
  all candidates of the corpus.

The strata are at most 5 * 17 and the p-values are counted in 160 bins, so what is
gathered over the corpus has a fixed size.  Texts are scanned once: the found spans
(not the texts) are checkpointed, then counted, then judged.

Defined cases: a null or empty text has no spans; every input row gives one row,
repeated rows and null ids too; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
RANDOM_P, RATE, BINS, BIN = 0.001, 0.01, 160, 0.25
#: Alphabets, in the order of their codes.
ALPHABET = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Runs that an alphabet holds, in either case where case carries nothing; base64 takes the rest.
RUNS = {"hex": "^([0-9a-f]+|[0-9A-F]+)$", "base32": "^([A-Z2-7]+|[a-z2-7]+)$", "base36": "^([A-Z0-9]+|[a-z0-9]+)$", "base62": "^[A-Za-z0-9]+$"}
#: Chance that two signs of ordinary text written in an alphabet agree.
TEXT_IC = {"hex": 0.12, "base32": 0.066, "base36": 0.066, "base62": 0.062, "base64": 0.062}


def _spans(pattern: str, text: str = "_t") -> Column:
    """(start, end, s) of all leftmost non-overlapping matches, in code points.

    The text between matches comes from a split by the same pattern, so positions
    are running sums; only texts with a match are split.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    step = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("n"), m.alias("s")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")
    folded = F.aggregate(
        step,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["n"]).alias("end"), x["s"].alias("s")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(found) == 0, none).otherwise(folded)

#: Chance that a sign of ordinary text is of another class (upper, lower, digit, symbol) than the one before;
#: in one case only letters and digits take turns.
TEXT_TURNS = {"hex": 0.15, "base32": 0.05, "base36": 0.05, "base62": 0.15, "base64": 0.15}

#: The same chance for random signs, where it is tested.
RANDOM_TURNS = {"base32": 2 * 26 * 6 / 32**2, "base36": 2 * 26 * 10 / 36**2}

_CLASS = "CASE WHEN c.a >= 62 THEN int({v} >= 26) + int({v} >= 52) + int({v} >= 62) WHEN c.a = 16 THEN int({v} >= 10) ELSE int({v} >= 26) END"
_BATTERY_SQL = """
transform(transform(transform(_c, c -> named_struct('start', c.start, 'end', c.end, 's', c.s,
  'enc', CASE WHEN c.s RLIKE '^[0-9]+$' THEN NULL {which} ELSE 'base64' END)),
 c -> named_struct('start', c.start, 'end', c.end, 'enc', c.enc,
  'a', {size}, 'ic', {ic}, 'tt', {turns}, 'rt', {random_turns},
  'x', CASE WHEN c.enc IS NULL THEN array(0) ELSE transform(split(CASE WHEN c.enc = 'hex' THEN lower(c.s) WHEN c.enc IN ('base32', 'base36') THEN upper(c.s) ELSE translate(c.s, '-_', '+/') END, '(?<=.)(?=.)', -1),
        k -> locate(k, {alphabet}) - 1) END)),
 c -> named_struct('start', c.start, 'end', c.end, 'enc', c.enc, 'a', c.a, 'ic', c.ic, 'tt', c.tt, 'rt', c.rt, 'n', cast(size(c.x) as double),
  'sq', aggregate(sequence(0, c.a - 1), 0D, (t, k) -> t + pow(size(filter(c.x, v -> v = k)), 2)),
  'hi', cast(size(filter(c.x, v -> v >= c.a / 2)) as double),
  'runs', 1D + aggregate(sequence(1, greatest(size(c.x) - 1, 1)), 0D, (t, i) -> t + CASE WHEN size(c.x) > 1 AND (c.x[i] >= c.a / 2) <> (c.x[i - 1] >= c.a / 2) THEN 1 ELSE 0 END),
  'turns', aggregate(sequence(1, greatest(size(c.x) - 1, 1)), 0D, (t, i) -> t + CASE WHEN size(c.x) > 1 AND {cls_now} <> {cls_before} THEN 1 ELSE 0 END),
  'sum', aggregate(c.x, 0D, (t, v) -> t + v), 'sumsq', aggregate(c.x, 0D, (t, v) -> t + v * v),
  'lag', aggregate(sequence(1, greatest(size(c.x) - 1, 1)), 0D, (t, i) -> t + CASE WHEN size(c.x) > 1 THEN cast(c.x[i] as double) * c.x[i - 1] ELSE 0 END) + cast(c.x[0] as double) * c.x[size(c.x) - 1]))
"""
_Z_SQL = """
transform(_b, c -> named_struct('start', c.start, 'end', c.end, 'enc', c.enc, 'n', c.n,
  'z_chi', (pow(greatest((c.a / c.n * c.sq - c.n) / (c.a - 1), 0D), 1D / 3) - (1 - 2D / (9 * (c.a - 1)))) / sqrt(2D / (9 * (c.a - 1))),
  'z_runs', CASE WHEN c.hi = 0 OR c.hi = c.n THEN 99D ELSE
     (c.runs - (2 * c.hi * (c.n - c.hi) / c.n + 1)) / sqrt(greatest(2 * c.hi * (c.n - c.hi) * (2 * c.hi * (c.n - c.hi) - c.n) / (c.n * c.n * (c.n - 1)), 1e-9D)) END,
  'z_lag', CASE WHEN c.n * c.sumsq - c.sum * c.sum <= 0 THEN 99D ELSE
     ((c.n * c.lag - c.sum * c.sum) / (c.n * c.sumsq - c.sum * c.sum) + 1 / (c.n - 1)) * sqrt(c.n) END,
  'z_turns', CASE WHEN c.rt IS NULL THEN 0D ELSE (c.rt * (c.n - 1) - c.turns) / sqrt(c.rt * (2 - 3 * c.rt) * (c.n - 1)) END,
  'z_text', ((c.turns - c.tt * (c.n - 1)) / sqrt(c.tt * (1 - c.tt) * (c.n - 1))
     - ((c.sq - c.n) / (c.n * (c.n - 1)) - c.ic) / sqrt(1.6D * c.ic * c.ic / c.n + 2 * c.ic * (1 - c.ic) / (c.n * c.n))) / sqrt(2D)))
"""


def _by_enc(values: dict[str, str]) -> str:
    return "CASE c.enc " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _phi_sql(z: str) -> str:
    return f"greatest(1D / (1D + exp(-(1.5976D * ({z}) + 0.070566D * pow({z}, 3)))), 1e-40D)"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Per row: doc_id, the base spans (assign, access, hex) and the tested candidates; lineage not cut."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), *([F.struct("*").alias("_row")] if keep_row else []))
    src = src.withColumn("assign", _spans(ASSIGN)).withColumn("access", _spans(ACCESS)).withColumn("hex", _spans(HEX)).withColumn("_c", _spans(CANDIDATE))
    long_value = F.filter("assign", lambda m: F.char_length(F.regexp_extract(m["s"], ASSIGN, 2)) >= 12)
    thin = lambda c: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    base = F.array_union(F.array_union(thin(long_value), thin(F.col("access"))), thin(F.col("hex")))
    src = src.withColumn("_base", base).withColumn("assign", thin(long_value)).withColumn("access", thin(F.col("access"))).withColumn("hex", thin(F.col("hex")))
    outside = F.filter("_c", lambda c: ~F.exists("_base", lambda m: (c["start"] < m["end"]) & (m["start"] < c["end"])))
    src = src.withColumn("_c", F.when(F.size("_c") == 0, F.col("_c")).otherwise(outside))
    sql = _BATTERY_SQL.format(
        which=" ".join(f"WHEN c.s RLIKE '{r}' THEN '{k}'" for k, r in RUNS.items()),
        size=_by_enc({k: str(len(v)) for k, v in ALPHABET.items()}),
        ic=_by_enc({k: f"{v}D" for k, v in TEXT_IC.items()}),
        turns=_by_enc({k: f"{v}D" for k, v in TEXT_TURNS.items()}),
        random_turns=_by_enc({k: f"{v}D" for k, v in RANDOM_TURNS.items()}),
        alphabet=_by_enc({k: f"'{v}'" for k, v in ALPHABET.items()}),
        cls_now=_CLASS.format(v="c.x[i]"),
        cls_before=_CLASS.format(v="c.x[i - 1]"),
    )
    src = src.withColumn("_b", F.filter(F.expr(sql), lambda c: c["enc"].isNotNull())).withColumn("_z", F.expr(_Z_SQL))
    two = lambda z: f"2 * least({_phi_sql(z)}, {_phi_sql('-(' + z + ')')})"
    tested = F.expr(
        f"""transform(_z, c -> named_struct('start', c.start, 'end', c.end,
          'stratum', concat(c.enc, ':', cast(least(cast(floor(c.n / 8) as int), 16) as string)),
          'ok', {_phi_sql('-c.z_chi')} >= {RANDOM_P}D AND {two('c.z_runs')} >= {RANDOM_P}D AND {two('c.z_lag')} >= {RANDOM_P}D AND {_phi_sql('-c.z_turns')} >= {RANDOM_P}D,
          'bin', cast(least(floor(-log10({_phi_sql('-c.z_text')}) / {BIN}D), {BINS - 1}) as int)))"""
    )
    return src.select("doc_id", "assign", "access", "hex", tested.alias("tested"), *(["_row"] if keep_row else []))


def thresholds(found: DataFrame, rate: float = RATE) -> DataFrame:
    """Benjamini-Hochberg per stratum: one row (t), a map from stratum to the least bin that passes.

    A candidate inconsistent with randomness keeps its place among the trials with p = 1.
    """
    trials = found.select(F.explode("tested").alias("c")).select(F.col("c.stratum").alias("stratum"), F.when(F.col("c.ok"), F.col("c.bin")).otherwise(0).alias("bin"))
    counts = trials.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    per = counts.groupBy("stratum").agg(F.collect_list(F.struct("bin", "n")).alias("bins"), F.sum("n").alias("trials"))
    passing = F.filter("bins", lambda b: F.pow(F.lit(10.0), -b["bin"] * BIN) * F.col("trials") <= F.lit(rate) * F.aggregate("bins", F.lit(0).cast("long"), lambda t, o: t + F.when(o["bin"] >= b["bin"], o["n"]).otherwise(0)))
    least = per.select("stratum", F.array_min(F.transform(passing, lambda b: b["bin"])).alias("least")).where("least is not null")
    return least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("t"))


def _all_spans(base_only: bool = False) -> Column:
    """Sorted array of (start, order, end, kind)."""
    tag = lambda k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(k)).alias("o"), m["end"].alias("end"), F.lit(k).alias("kind")))
    return F.array_sort(F.concat(*[tag(k) for k in KINDS[: 3 if base_only else 4]]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, keep_row: bool = False) -> DataFrame:
    """Per row: doc_id, spans by kind (assign, access, hex, random: arrays of start and end) and all of them, sorted."""
    found = sparkkit.cut(find_spans(docs, id_col, text_col))
    t = thresholds(found, rate).scalar()
    if keep_row:  # texts are scanned again rather than checkpointed
        found = find_spans(docs, id_col, text_col, keep_row=True)
    hit = F.filter("tested", lambda c: c["ok"] & (c["bin"] >= F.try_element_at(F.col("_thr"), c["stratum"])))
    out = found.withColumn("_thr", t).withColumn("random", F.transform(hit, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    return out.drop("_thr", "tested").withColumn("spans", _all_spans()).withColumn("base", _all_spans(True))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """The input's columns with every secret span replaced by ``mark``; texts without one stay as they are.

    Columns ``n_chars`` follow the text where they exist.
    """
    text = F.col("_row")[text_col]
    init = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, m: F.struct(
        F.when(m["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, m["start"] - a["at"]), F.lit(mark))).alias("out"),
        F.greatest(a["at"], m["end"]).alias("at"),
    )
    new = F.aggregate("spans", init, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2**30))))
    out = secret_spans(docs, id_col, text_col, rate, keep_row=True).withColumn("_new", F.when(F.size("spans") > 0, new).otherwise(text))
    cols = []
    for f in docs.schema:
        old = F.col("_row")[f.name]
        if f.name == text_col:
            cols.append(F.col("_new").alias(f.name))
        elif f.name == "n_chars":
            cols.append(F.when(F.size("spans") > 0, F.char_length("_new").cast(f.dataType)).otherwise(old).alias(f.name))
        else:
            cols.append(old.alias(f.name))
    return out.select(*cols)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_spans(sparkkit.table(spark, sf_dir, "documents"))
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), n("random"))
