"""Streams: scan files as they come, report findings once, re-match inventories for new advisories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeaudit.functions import text as T
from lakeaudit.operators import advisories as D
from lakeaudit.operators import scan as S


def stream_scan(files: DataFrame, rules: tuple[S.Rule, ...] = S.RULES) -> DataFrame:
    """Findings of a stream of files, without state: false matches go, scope and base fingerprint are added.

    Occurrences aren't numbered and broad rules aren't dropped for precise ones, as both need a file's findings together
    with others; each is exact within a batch when done in foreachBatch.
    """
    hits = S.with_scope(S.drop_excluded(S.scan_rules(files, rules), rules))
    return hits.withColumn("fingerprint", T.fingerprint_base(1, F.col("category"), F.col("rule_id"), F.col("path"), F.col("context")))


def stream_new_findings(findings: DataFrame, time_col: str, keep: str = "1 hour", keys: tuple[str, ...] = ("project_id", "fingerprint")) -> DataFrame:
    """The first of each key within the watermark; one that comes again after it may be reported again. State is bounded by keep."""
    return findings.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(list(keys))


def stream_monitor(advisories: DataFrame, inventory: DataFrame, reported: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """For each batch of advisories, write the matches of the stored inventory that reported() doesn't hold yet.

    write must put rows where reported() reads them: a batch that runs again then adds nothing.
    """

    def each(batch: DataFrame, _: int) -> None:
        write(D.monitor(inventory, batch, reported()))

    return advisories.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, kind: str, size: str, late: str) -> DataFrame:
    """Events by window and kind; ones later than the watermark are left out of a closed window."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
