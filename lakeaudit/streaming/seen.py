"""New findings for good: a stored table of the keys that a stream has seen, with the times of the first and the last sight.

A key is new if the table lacks it, or if it was last seen longer than the retention before; so no watermark decides, and a
key that comes back late isn't reported again. Each batch writes what it saw, and what was new, under its own number, and
reads only what earlier batches wrote: a batch that runs again gives the same and replaces itself. Every few batches
the table is folded to a row a key, without the expired ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class SeenTable:
    """folder: a path that driver and executors share; it outlives queries. keys, time_col: of the stream."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], time_col: str, retention: str = "90 days", fold_every: int = 20):
        self.spark, self.folder, self.keys, self.time_col, self.retention, self.fold_every = spark, folder, keys, time_col, retention, fold_every

    def _numbers(self, part: str) -> list[int]:
        """The numbers under which finished writes lie, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = (s.getPath() for s in fs.listStatus(path))
        return sorted(int(p.getName().split("=")[1]) for p in done if "=" in p.getName() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def before(self, batch: int) -> DataFrame | None:
        """keys, first_seen, last_seen as of the batches before; a key may have several rows."""
        folded = [n for n in self._numbers("folded") if n < batch]
        since = folded[-1] if folded else -1
        paths = [f"{self.folder}/folded/upto={n}" for n in folded[-1:]] + [f"{self.folder}/seen/batch={n}" for n in self._numbers("seen") if since < n < batch]
        return self.spark.read.parquet(*paths) if paths else None

    def take(self, batch: DataFrame, number: int) -> None:
        """Write the batch's new keys, each with its first row there, and what it saw."""
        own = F.col(self.time_col)
        rest = [c for c in batch.columns if c not in self.keys]
        known = batch.where(own.isNotNull())
        for k in self.keys:
            known = known.where(F.col(k).isNotNull())
        first = known.groupBy(*self.keys).agg(F.min(F.struct(own.alias("_at"), *rest)).alias("x"), F.max(own).alias("last_seen"))
        first = first.select(*self.keys, "x.*", "last_seen")
        held = self.before(number)
        fresh = first
        if held is not None:
            last = held.groupBy(*self.keys).agg(F.max("last_seen").alias("_last"))
            fresh = first.join(last, self.keys, "left").where(F.col("_last").isNull() | (F.col("_last") < F.col("_at") - F.expr(f"interval {self.retention}"))).drop("_last")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{self.folder}/new/batch={number}")
        first.select(*self.keys, F.col("_at").alias("first_seen"), "last_seen").write.mode("overwrite").parquet(f"{self.folder}/seen/batch={number}")
        if (number + 1) % self.fold_every == 0:
            self.fold(number)

    def fold(self, number: int) -> None:
        """One row a key for the batches up to this one; keys that the newest time has left behind by the retention go."""
        rows = self.before(number + 1)
        newest = F.lit(rows.agg(F.max("last_seen")).first()[0])
        kept = rows.groupBy(*self.keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).where(F.col("last_seen") >= newest - F.expr(f"interval {self.retention}"))
        kept.write.mode("overwrite").parquet(f"{self.folder}/folded/upto={number}")

    def new(self) -> DataFrame | None:
        """Every row that was new, with the number of its batch."""
        return self.spark.read.parquet(f"{self.folder}/new") if self._numbers("new") else None


def stream_first_seen(findings: DataFrame, table: SeenTable, checkpoint: str) -> StreamingQuery:
    """Run a stream of findings through the table until its input ends. Rows without a key or a time are left out."""
    return findings.writeStream.foreachBatch(lambda batch, n: table.take(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
