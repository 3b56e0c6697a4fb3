"""Message history by day, clustered by recipient, with compaction of cold days (IO-17, IO-18, IO-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import BatchTable, _place

DAY = 86400


class History(BatchTable):
    """Messages in appended batches, a bucket being a day of integer seconds. Rows of a day are clustered by
    recipient and type, newest first, and dealt by ranges of that order, so a crowded day is no single task;
    a reader of one recipient skips the row groups of others by their statistics.

    Compaction rewrites cold days, which many batches have written to, as one clustered part; readers
    see the day as it was until that part is complete.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, tasks: int = 8, row_group_bytes: int = 16 << 20):
        super().__init__(spark, path, schema, "created_at", tasks)
        self.options = {"parquet.block.size": str(row_group_bytes)}

    def bucket(self) -> Column:
        return F.floor(F.col("created_at") / DAY).cast("int")

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        newest = [F.desc("created_at"), F.desc("message_id")]
        return rows.repartitionByRange(max(n, self.buckets), "b", "to_id", "group_type", *newest).sortWithinPartitions("b", "to_id", "group_type", *newest)

    def _compactions(self) -> set[int]:
        return set(self._names(f"{self.path}/_compacted", r"(\d+)"))

    def parts(self, touched: list[int] | None = None) -> list[tuple[int, int]]:
        """(batch, day): of each day its last compaction and what was appended since."""
        done = self.batches()
        written, compactions = self._written(done), self._compactions()
        since = {b: v for v, b in written if v in compactions}
        return [(v, b) for v, b in written if v >= since.get(b, v) and (touched is None or b in touched)]

    def days(self) -> list[int]:
        return sorted({b for _, b in self.parts()})

    def between(self, start: int, end: int) -> DataFrame:
        """Messages of start <= created_at <= end; other days are not opened."""
        days = [b for b in self.days() if start // DAY <= b <= end // DAY]
        return self.current(days).where(F.col("created_at").between(start, end))

    def compact(self, batch: int, before_day: int) -> bool:
        """Rewrites the days before `before_day` that have more than one part; False if there are none."""
        parts = [p for p in self.parts() if p[1] < before_day]
        cold = sorted(b for b in {b for _, b in parts} if sum(p[1] == b for p in parts) > 1)
        if not cold or batch in self.batches():
            return False
        mark, files = _place(self.spark, f"{self.path}/_compacted/{batch}")
        files.create(mark, True).close()
        return self.write(batch, self.current(cold), cold)
