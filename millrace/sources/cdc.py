"""Change streams as a Python data source, dealt out by a hash of the document's key.

``spark.readStream.format("change_log")`` tails a log of change documents (JSON lines,
one change each) kept in a folder, local or named by a URI.  The offset is a resume token,
the number of lines consumed; N splits read the files of the same range and keep the
documents whose key hashes to them, as a server-side filter would.  A file is counted
again only when its size or time changes, and lines are streamed.  A line that is no
change document passes as a row without an operation, which the parser makes a dead
letter.  The engine's offset log takes the place of split assignment, snapshots and token
serialisation.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import islice

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .. import model
from ..operators.flow import union

COLUMNS = "op string, db string, collection string, document_key string, full_document string, update_description string, cluster_time struct<sec:bigint,inc:int>"
DEFAULT_READERS = 4


class LostPosition(RuntimeError):
    """The resume token lies beyond the log."""


def split_filter(key: Column, index: int, splits: int) -> Column:
    """Condition of one of several splits; one split takes all."""
    return F.lit(True) if splits <= 1 else F.pmod(F.xxhash64(key), F.lit(splits)) == index


def in_split(key: str, index: int, splits: int) -> bool:
    return splits <= 1 or zlib.crc32(key.encode()) % splits == index


class Split(InputPartition):
    def __init__(self, index: int, splits: int, pieces: list[tuple[str, int, int]]):
        super().__init__((index, splits))
        self.index, self.splits, self.pieces = index, splits, pieces


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.splits = int(options.get("splits", "1"))
        self.start = options.get("startToken")
        self.on_lost = options.get("onLostPosition", "fail")
        self.known: dict[str, tuple[tuple, int]] = {}

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def _lines(self, fs: pafs.FileSystem, path: str) -> Iterator[str]:
        with fs.open_input_stream(path) as f:
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (x.decode("utf-8", "replace") for x in whole if x.strip())
            if rest.strip():
                yield rest.decode("utf-8", "replace")

    def _counts(self) -> list[tuple[str, int]]:
        """The log's files in order, with their numbers of lines."""
        fs, base = self._open()
        files = [i for i in fs.get_file_info(pafs.FileSelector(base)) if i.is_file and ".json" in i.base_name]
        out = []
        for i in sorted(files, key=lambda i: i.base_name):
            state = (i.size, i.mtime_ns)
            if self.known.get(i.path, (None, 0))[0] != state:
                self.known[i.path] = (state, sum(1 for _ in self._lines(fs, i.path)))
            out.append((i.path, self.known[i.path][1]))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        n = sum(k for _, k in self._counts())
        token = n if self.start == "latest" else int(self.start or 0)
        if token > n:
            if self.on_lost != "latest":
                raise LostPosition(f"resume token {token} lies beyond the log's {n} changes")
            token = n
        return {"token": token}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"token": sum(k for _, k in self._counts())}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        pieces, at = [], 0
        for path, n in self._counts():
            lo, hi = max(start["token"] - at, 0), min(end["token"] - at, n)
            if lo < hi:
                pieces.append((path, lo, hi))
            at += n
        return [Split(i, self.splits, pieces) for i in range(self.splits)]

    def read(self, partition: Split) -> Iterator[tuple]:
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        fs, _ = self._open()
        for path, lo, hi in partition.pieces:
            for line in islice(self._lines(fs, path), lo, hi):
                try:
                    d = json.loads(line)
                    t = d.get("clusterTime")
                    row = (d.get("op") or d.get("operationType"), d.get("db"), d.get("collection"), text(d.get("documentKey")), text(d.get("fullDocument")), text(d.get("updateDescription")), (int(t["sec"]), int(t["inc"])) if t else None)
                except (ValueError, AttributeError, KeyError, TypeError):
                    row = (None, None, None, None, line, None, None)
                if in_split(row[3] or "", partition.index, partition.splits):
                    yield row

    def commit(self, end: dict) -> None:
        pass


class ChangeLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema) -> ChangeLogReader:  # noqa: N802
        return ChangeLogReader(self.options)


def change_stream(spark: SparkSession, path: str, splits: int = 1, start: str | None = None, on_lost: str = "fail") -> DataFrame:
    """One change stream with so many splits."""
    spark.dataSource.register(ChangeLogSource)
    r = spark.readStream.format("change_log").option("path", path).option("splits", str(splits)).option("onLostPosition", on_lost)
    return (r.option("startToken", start) if start is not None else r).load()


def multi_reader(spark: SparkSession, path: str, readers: int = DEFAULT_READERS) -> DataFrame:
    """As many splits as readers; fewer than two is the plain stream."""
    return change_stream(spark, path, max(1, readers))


def hash_splits(df: DataFrame, key: str, splits: int) -> DataFrame:
    """The union of a frame's splits: each row once."""
    parts = [df.where(split_filter(F.col(key), i, splits)).withColumn("_split", F.lit(i)) for i in range(max(1, splits))]
    return union(*parts)


def poll_errors(message: str, raw: Column, df: DataFrame) -> DataFrame:
    return model.dead_letters(df, model.SOURCE_PARSING_ERROR, F.lit(message), "ChangeStreamSource", raw)
