"""Pages by rank: findings stored in order in ranges, with the number of rows of each, so that an offset opens only its range.

A range is a file, or a few, of rows that lie together in the order; the counts are a small table beside them. A page
at any offset reads the ranges that hold it, one or two, and the totals are the counts' sum: nothing is sorted when a page
is asked for.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_PARTS = 400  #: tasks that sort, while they have no more than MOST_ROWS rows each
MOST_ROWS = 5_000_000


def write_ranked(findings: DataFrame, order: list[Column], folder: str, per: int = 100_000) -> None:
    """Store findings in ranges of about per rows, and the ranges' counts. order must tell all rows apart, or pages may part equal ones anew."""
    n = findings.count()
    # Tasks are bounded, as each adds a sample of the rows to what the driver sees; a task cuts its sorted rows into ranges.
    parts = max(1, min(-(-n // per), max(MOST_PARTS, n // MOST_ROWS)))
    place = F.monotonically_increasing_id()  # the partition, and in the lower 33 bits the row's place in it
    cut = F.shiftright(place, 33) * (-(-n // per) + 1) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / per)
    dealt = findings.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_range", cut)
    writer = dealt.write.mode("overwrite")
    (writer.partitionBy("_range") if n else writer).parquet(f"{folder}/rows")  # an empty table has no folder for a range
    stored = findings.sparkSession.read.parquet(f"{folder}/rows")
    stored.groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts")


class Ranked:
    """A stored table of write_ranked. Its counts, one number a range, are held by the driver."""

    def __init__(self, spark: SparkSession, folder: str, order: list[Column]):
        self.spark, self.folder, self.order = spark, f"{folder}/rows", order
        counts = sorted((r["_range"], r["n"]) for r in spark.read.parquet(f"{folder}/counts").collect())
        self.ranges, self.ends = [r for r, _ in counts], list(accumulate(n for _, n in counts))

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def holding(self, offset: int, limit: int) -> tuple[list[int], int]:
        """The ranges that hold the page, and the rows before them."""
        first, last = bisect_right(self.ends, offset), bisect_right(self.ends, offset + max(1, limit) - 1)
        return self.ranges[first : last + 1], self.ends[first - 1] if first else 0

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit - 1 in the order; none beyond the end."""
        wanted, before = self.holding(offset, limit)
        # Only the page's ranges are listed; the first one gives an empty page its columns.
        own = self.spark.read.option("basePath", self.folder).parquet(*(f"{self.folder}/_range={k}" for k in wanted or self.ranges[:1])) if self.ranges else self.spark.read.parquet(self.folder)
        return own.where(F.col("_range").isin(wanted) if wanted else F.lit(False)).drop("_range").orderBy(*self.order).offset(offset - before).limit(limit)
