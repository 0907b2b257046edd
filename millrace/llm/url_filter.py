"""URL filtering: host and path rules, and gradient-boosted trees on lexical features.

Rules (a host with a path prefix, allow or block) decide the URLs they fit, the longest
rule first.  All other URLs are judged by gradient-boosted trees with logistic loss and
balanced classes, trained on labelled URLs; a URL is blocked if its balanced probability
exceeds BLOCK_AT.  Features of a URL: lengths, depth, labels of the host, digit ratio,
entropy, hyphens, parameters and their length, scheme, fragment, extension; and
statistics that grouped aggregations count over *all* URLs: how far its length, depth,
digit ratio and parameters lie from the mean of its address suffix, in standard
deviations; how many URLs its suffix and domain have; and their smoothed share of blocked
among labelled URLs of other folds than its own, so no URL's label is its own feature.

Without a label column the labels are the verdicts of the rules.  A rule fixes a host's
whole suffix, so counts and shares by suffix would only repeat the rule on URLs it does
not fit: they are left out (0) then, and the lexical features and distances decide.

The trees are fitted on a hash sample of about SAMPLE_ROWS labelled rows (the bound is
a parameter; the sample's features are all that reaches the driver).  The model holds
TREES * 2**DEPTH numbers and goes to the tasks with the function.  Counts by suffix and
domain are tables of their own, joined by plain equi-joins, so adaptive execution
broadcasts small ones and splits hot keys.

Defined cases: a null url, or one without ``://``, has an empty host and path; it is
judged by its (empty) features.  Without labels, or with one class alone, the trees give
that class (allow, if there is none).  Rows are judged one by one, repeated ones too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit

#: Rules of the registered query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SAMPLE_ROWS, TREES, DEPTH, RATE, SPLITS, LEAST_ROWS, L2 = 8000, 40, 3, 0.2, 32, 20, 1.0
#: Pseudo-count of the overall share in the smoothed shares, folds of these, least probability of a block.
SMOOTH, FOLDS, BLOCK_AT = 20.0, 5, 0.7
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "hyphens", "params", "query_length", "https", "fragment", "extension", "www", "length_off", "depth_off", "digits_off", "params_off", "suffix_n", "suffix_rate", "domain_n", "domain_rate")
STATS = FEATURES[-8:]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for a null url or one without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.lit(2**30))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (host and path lengths added; of equals, the longer host), or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def lexical(url: str | None, host: str, path: str, with_domain: bool = True) -> list[float]:
    """Features of a URL; without its domain (the host's last two labels) the letters of that do not count."""
    u = url or ""
    v = u if with_domain else u.replace(".".join(host.split(".")[-2:]), "", 1)
    n = max(len(v), 1)
    counts = {c: v.count(c) for c in set(v)}
    query = u.split("?", 1)[1].split("#", 1)[0] if "?" in u else ""
    last = path.rsplit("/", 1)[-1]
    return [
        float(len(u)), float(len(host)), float(len(path)), float(sum(1 for s in path.split("/") if s)), float(host.count(".") + 1),
        sum(counts.get(d, 0) for d in "0123456789") / n, -sum(v / n * math.log2(v / n) for v in counts.values()), float(host.count("-")),
        float(len([x for x in query.split("&") if x])), float(len(query)), float(u[:6].lower() == "https:"), float("#" in u), float("." in last), float(host.startswith("www.")),
    ]


@dataclass
class Trees:
    """Complete binary trees: split feature and limit per inner node, value per leaf."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def _limits(v: np.ndarray) -> np.ndarray:
    """Limits of splits: midway between a quantile and the next larger value."""
    if not len(v):
        return np.zeros(0)
    known = np.unique(v)
    at = np.unique(np.searchsorted(known, np.quantile(v, np.linspace(0, 1, SPLITS + 1)[1:-1]), side="right"))
    at = at[at < len(known)]
    return (known[at - 1] + known[at]) / 2


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Boosted regression trees on logistic loss, both classes of equal weight, splits by the second-order gain over quantile bins."""
    p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    if 0 < y.sum() < len(y):
        weight, p = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), 0.5
    base, inner, leaves = float(np.log(p / (1 - p))), 2**DEPTH - 1, 2**DEPTH
    edges = [_limits(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    score, out = np.full(len(x), base), Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(x) or y.min() == y.max():
        return out
    feats, limits, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = weight * (y - prob), weight * prob * (1 - prob)
        feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf)
            if len(rows) >= 2 * LEAST_ROWS:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    m = len(e) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=m))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                    gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, float(e[i]))
            feature[k], limit[k] = best[1], best[2]
            node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + L2)
        score += v[leaf]
        feats.append(feature)
        limits.append(limit)
        values.append(v)
    return Trees(base, np.array(feats), np.array(limits), np.array(values))


def _matrix(b: pa.RecordBatch, with_domain: bool = True) -> np.ndarray:
    lex = [lexical(u, h, p, with_domain) for u, h, p in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
    stats = [np.asarray(b.column(i), dtype=float) for i in range(3, 3 + len(STATS))]
    return np.hstack([np.array(lex, float).reshape(len(lex), len(FEATURES) - len(STATS)), np.stack(stats, axis=1)])


def with_statistics(df: DataFrame, by_label: bool = True) -> DataFrame:
    """Adds the columns STATS; needs columns id, url, host, path and label (1, 0 or null)."""
    labels = F.split("host", r"\.")
    n = F.greatest(F.length("url"), F.lit(1))
    plain = lambda parts: F.size(F.filter(parts, lambda x: x != ""))
    sizes = {
        "length": F.length("url").cast("double"),
        "depth": plain(F.split("path", "/")).cast("double"),
        "digits": F.length(F.regexp_replace("url", "[^0-9]", "")) / n,
        "params": plain(F.split(F.regexp_extract("url", r"(?s)^[^?]*\?([^#]*)", 1), "&")).cast("double"),
    }
    df = df.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)))
    df = df.withColumns({f"_{k}": F.coalesce(v, F.lit(0.0)) for k, v in sizes.items()}).withColumn("_fold", F.pmod(F.xxhash64("id", "url"), F.lit(FOLDS)))
    in_fold = lambda i, c: F.sum(F.when(F.col("_fold") == i, c).otherwise(0.0))
    counts = [F.count("*").alias("n"), F.array(*[in_fold(i, F.col("label").isNotNull().cast("double")) for i in range(FOLDS)]).alias("m"), F.array(*[in_fold(i, F.coalesce("label", F.lit(0.0))) for i in range(FOLDS)]).alias("s")]
    moments = [f(F.col(f"_{k}") ** e).alias(f"{k}{e}") for k in sizes for e, f in ((1, F.sum), (2, F.sum))]
    domains = sparkkit.cut(df.groupBy("suffix", "domain").agg(*counts, *moments))
    each = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(FOLDS)]).alias(c)
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), each("m"), each("s"), *[F.sum(f"{k}{e}").alias(f"{k}{e}") for k in sizes for e in (1, 2)])
    total = suffixes.agg(each("m"), each("s")).first()
    m, s = sum(x or 0.0 for x in total["m"]), sum(x or 0.0 for x in total["s"])
    share = s / m if m else 0.0
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
    rates = F.transform(F.sequence(F.lit(0), F.lit(FOLDS)), lambda i: (added(F.col("s")) - F.coalesce(F.get("s", i), F.lit(0.0)) + share * SMOOTH) / (added(F.col("m")) - F.coalesce(F.get("m", i), F.lit(0.0)) + SMOOTH))
    mean = {k: F.col(f"{k}1") / F.col("n") for k in sizes}
    spread = {k: F.sqrt(F.greatest(F.col(f"{k}2") / F.col("n") - mean[k] * mean[k], F.lit(0.0))) for k in sizes}
    suffixes = suffixes.select(F.col("suffix").alias("sx"), F.log1p("n").alias("suffix_n"), rates.alias("suffix_rates"), *[v.alias(f"{k}_mean") for k, v in mean.items()], *[v.alias(f"{k}_spread") for k, v in spread.items()])
    stats = domains.select("suffix", F.col("domain").alias("dm"), F.log1p("n").alias("domain_n"), rates.alias("domain_rates")).join(suffixes, F.col("suffix") == F.col("sx")).drop("suffix")
    df = df.join(sparkkit.cut(stats), (F.col("domain") == F.col("dm")) & (F.col("suffix") == F.col("sx")), "left")
    # an unlabelled URL takes the share of all folds, which stands last
    at = F.when(F.col("label").isNotNull(), F.col("_fold")).otherwise(FOLDS).cast("int")
    for k in sizes:
        df = df.withColumn(f"{k}_off", F.when(F.col(f"{k}_spread") > 1e-9, F.round((F.col(f"_{k}") - F.col(f"{k}_mean")) / F.col(f"{k}_spread"))).otherwise(0.0))
    df = df.withColumn("suffix_rate", F.get("suffix_rates", at)).withColumn("domain_rate", F.get("domain_rates", at))
    return df if by_label else df.withColumns({c: F.lit(0.0) for c in STATS[-4:]})


def judge(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, label_col: str | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score; labels (1 block, 0 allow) come from the rules or a column."""
    host, path = split_url(F.col(url_col))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), (F.col(label_col).cast("double") if label_col else F.lit(None).cast("double")).alias("label"))
    df = df.withColumn("rule", name).withColumn("by_rule", verdict)
    if not label_col:
        df = df.withColumn("label", F.when(F.col("by_rule") == "block", 1.0).when(F.col("by_rule") == "allow", 0.0))
    cols = ["url", "host", "path", *STATS]
    full = with_statistics(df, by_label=label_col is not None)
    labelled = full.where("label is not null")
    n = df.where("label is not null").count()
    every = max(1, n // sample_rows)
    part = labelled if every == 1 else labelled.where(F.pmod(F.xxhash64("id", "url"), F.lit(every)) == 0)
    take = lambda rows: rows.select(*cols, "label").limit(2 * sample_rows).toArrow().combine_chunks().to_batches()
    got = take(part)
    if n and not any(b.num_rows for b in got):  # all labelled rows have one hash
        got = take(labelled)
    known = label_col is not None
    x = np.concatenate([_matrix(b, known) for b in got]) if got else np.zeros((0, len(FEATURES)))
    y = np.concatenate([np.asarray(b.column(len(cols)), dtype=float) for b in got]) if got else np.zeros(0)
    model = fit_trees(x, y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b, known)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[len(cols) :], b.column(1), b.column(2), pa.array(s)], names=["id", "rule", "by_rule", "host", "path", "score"])

    kind = dict(df.dtypes)["id"]
    out = full.select(*cols, "id", "rule", "by_rule").mapInArrow(score, f"id {kind}, rule string, by_rule string, host string, path string, score double")
    return out.select("id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > math.log(BLOCK_AT / (1 - BLOCK_AT)), "block").otherwise("allow")).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(sparkkit.table(spark, sf_dir, "pages").select("page_id", "url"))
    return got.withColumnRenamed("id", "page_id").drop("score")
