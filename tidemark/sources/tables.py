"""Tables that grow by batches: bucketed Parquet whose batches count once they are complete.

A batch writes only the buckets it changes, under its own folder, and is then marked done; readers see done
batches only. So a write that is lost half-way leaves the table as it was and may be tried again, a
repeated batch changes nothing, and files of untouched buckets stay where they are.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir; it goes when the session
    ends. Only local mode without that setting takes a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    path = f"{named.rstrip('/')}/{uuid.uuid4().hex}"
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    return path


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class BatchTable:
    """Rows of `schema`, dealt by `key` to `buckets` buckets, in batches with rising numbers.

    `current()` takes each bucket from the last batch that wrote it, which makes a state table whose batches replace
    buckets; `all()` takes all batches, which makes a log.
    """

    options: dict[str, str] = {}  # of the Parquet writer

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _names(self, path: str, pattern: str) -> list[int]:
        at, files = _place(self.spark, path)
        found = files.listStatus(at) if files.exists(at) else []
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(pattern, f.getPath().getName())))

    def batches(self) -> list[int]:
        """The batches that are complete."""
        return self._names(f"{self.path}/_done", r"(\d+)")

    def _folder(self, batch: int, bucket: int | None = None) -> str:
        return f"{self.path}/v={batch}" + ("" if bucket is None else f"/b={bucket}")

    def _written(self, batches: list[int]) -> list[tuple[int, int]]:
        return [(v, b) for v in batches for b in self._names(self._folder(v), r"b=(-?\d+)")]

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """Rows with their bucket `b`, as they are written."""
        return rows.repartition(n, "b")

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        paths = [self._folder(v, b) for v, b in parts]
        names = self.spark.createDataFrame([], self.schema).columns
        return self.spark.read.schema(self.schema).parquet(*paths).select(*names)

    def parts(self, touched: list[int] | None = None) -> list[tuple[int, int]]:
        """(batch, bucket) of what `current` reads: each bucket's last batch."""
        last = {b: v for v, b in self._written(self.batches())}
        return sorted((v, b) for b, v in last.items() if touched is None or b in touched)

    def current(self, touched: list[int] | None = None) -> DataFrame:
        """Each bucket as its last batch left it; only the buckets asked for are read."""
        return self._read(self.parts(touched))

    def all(self, below: int | None = None, touched: list[int] | None = None) -> DataFrame:
        """The rows of all batches, or of those below a number; only the buckets asked for are read."""
        parts = self._written([v for v in self.batches() if below is None or v < below])
        return self._read([(v, b) for v, b in parts if touched is None or b in touched])

    def batch(self, number: int) -> DataFrame:
        return self._read(self._written([number]))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: a number for each, of `buckets` at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def write(self, batch: int, rows: DataFrame, touched: list[int] | None = None) -> bool:
        """Writes a batch, unless it is done. Buckets in `touched` that have no rows any more become empty."""
        if batch in self.batches():
            return False
        to, files = _place(self.spark, self._folder(batch))
        files.delete(to, True)  # what an attempt that was lost has left
        names = self.spark.createDataFrame([], self.schema).columns
        n = max(1, len(touched)) if touched is not None else self.buckets
        dealt = self._dealt(rows.select(*names, self.bucket().alias("b")), n)
        dealt.write.options(**self.options).partitionBy("b").parquet(self._folder(batch))
        for b in touched or ():
            files.mkdirs(_place(self.spark, self._folder(batch, b))[0])
        mark, files = _place(self.spark, f"{self.path}/_done/{batch}")
        files.create(mark, False).close()
        return True

    def sweep(self) -> int:
        """Deletes buckets that later batches replaced; for state tables, when nobody reads them any more."""
        kept = set(self.parts())
        gone = [p for p in self._written(self.batches()) if p not in kept]
        for v, b in gone:
            at, files = _place(self.spark, self._folder(v, b))
            files.delete(at, True)
        return len(gone)
