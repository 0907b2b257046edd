"""Spark helpers of the training-data operators: sizing, checkpoints, components."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a working table that a task writes, where their number is known.
ROWS_A_FILE = 1 << 16
#: Bits of a sieve for each id, and at most (16 MB).
SIEVE_BITS, MOST_SIEVE_BITS = 32, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: file sizes for a scan, no job is run."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return 1 << 30


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets(df: DataFrame, target: int, per_partition: int = 4, most: int = 1 << 20) -> int:
    """A power of two: so many buckets that each has about ``target`` input bytes, and that partitions get several each."""
    est = min(plan_bytes(df), 1 << 50)
    n = max(per_partition * partitions(df.sparkSession), est // target, 16)
    return min(most, 1 << math.ceil(math.log2(n)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder of our own only in local mode, where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """As few partitions as about so many small rows need, at most those there are."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_A_FILE)))


def written(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """Cuts lineage by a table in the shared folder, and the table's path.

    Loops use this: a checkpoint carries its plan's size estimate along, which grows
    with every join until planning takes longer than the work; a table has its real size.
    Given about how many ``rows`` there are, few are written by few tasks, however many
    partitions a shuffle has: every file costs its executor several processes, as Hadoop's
    local file system sets permissions by chmod.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df = df if rows is None else few(df, rows)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose worker hands unused memory back when a task's rows end, as idle workers keep theirs."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return run


def sifted(df: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key (a long) may be among ``ids``, a table of one such column, and those whose key is not.

    A bitmap of the ids' hashes is broadcast, so that an exact join of the first part need
    not shuffle the second.  About one row in SIEVE_BITS gets into the first part without
    need; more do where MOST_SIEVE_BITS bound the bitmap, and cost a shuffle, no more.
    """
    n = ids.count()
    if not n:
        return df.where(F.lit(False)), df
    bits = min(MOST_SIEVE_BITS, 1 << max(10, math.ceil(math.log2(SIEVE_BITS * n))))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    word = lambda c: F.shiftright(slot(c), 6).cast("int")
    at = lambda c: slot(c).bitwiseAND(F.lit(63)).cast("int")
    name = fresh(df, "words")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.int64)
        for b in batches:
            words[np.asarray(b.column(0))] = np.asarray(b.column(1))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))], names=[name])

    (c,) = (F.col(f"`{x}`") for x in ids.columns)
    sums = ids.groupBy(word(c).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at(c))).alias("b"))
    sieve, _ = written(sums.coalesce(1).mapInArrow(gathered, f"{name} array<long>"))
    found = F.call_function("shiftrightunsigned", F.get(F.col(name), word(key)), at(key)).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(sieve), found, "left_semi"), df.join(F.broadcast(sieve), found, "left_anti")


def _least(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """Edges (a, b) with m, the least b or a itself at each a.

    A vertex with over a quarter of a partition's share of the n edges is hot; there are at
    most 4 * parts of them, so their list may be broadcast.  Their edges are spread by a hash
    of b over as many keys as they have such shares, and only their minimum is repeated.
    """
    hot = max(n // (4 * parts), 64)
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.ceil(F.count("*") / hot).cast("int").alias("s"))
    many = low.where("s > 1").select(F.col("a").alias("hot"), F.col("s").alias("ways"))
    dealt = edges.join(F.broadcast(many), F.col("a") == F.col("hot"), "left")
    dealt = dealt.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("ways")), F.lit(0)).cast("int").alias("salt"))
    low = low.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"))
    return dealt.join(low, ["a", "salt"]).select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b): a row (id, component) per vertex, component the least id reachable.

    Alternating large-star and small-star steps: every step is a grouped minimum
    and an equi-join, salted at hubs, and the number of steps grows with the
    logarithm of the component size.  Lineage is cut by a table in the shared
    folder after each step; only the edge count comes to the driver.
    """
    spark = edges.sparkSession
    parts = partitions(spark)
    e, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    tally = lambda: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    last = tally()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, mid = written(_least(both, 2 * last["n"], parts).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), last["n"])
        joined = _least(large, last["n"], parts)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        old = path
        e, path = written(small.where("a <> b").distinct(), last["n"])
        remove(spark, [old, mid])
        now = tally()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    # settled: every vertex but a root has one edge, to its root
    roots = few(e.select(F.col("b").alias("id")).distinct(), last["n"]).withColumn("component", F.col("id"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def deal(df: DataFrame, col: str, parts: int) -> DataFrame:
    """Rows dealt out by a bucket number, bucket b to partition b mod parts: as even as the buckets are."""
    return df.repartitionById(parts, F.pmod(F.col(col), F.lit(parts)).cast("int"))
