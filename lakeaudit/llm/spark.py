"""Small helpers around a session: tables, lineage cuts and batch slicing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a task holds as numpy arrays at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share.

    Where a session on one machine names none, as in tests, a temporary folder is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, and read it from there: lost executors recompute nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _of_files(docs: DataFrame) -> bool:
    """Whether each row of docs is a row of a Parquet file that it reads, or what a projection or a filter makes of one."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic() or "_metadata" in docs.columns:
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def named(docs: DataFrame, name: str = "rid") -> DataFrame:
    """docs with a number (long) in column name that stands for a row in every job that reads docs.

    It is the row's place in its file, so it doesn't follow the partitions, which another number of cores may cut
    otherwise when the files are read again. Where docs isn't rows of Parquet files, rows are numbered once and written to
    the checkpoint folder, as they are.
    """
    if not _of_files(docs):
        return cut(docs.withColumn(name, F.monotonically_increasing_id()))
    place = F.col("_metadata.row_index")
    if len(docs.inputFiles()) == 1:
        return docs.select("*", place.alias(name))
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # reads no column
    own = docs.select("*", F.col("_metadata.file_path").alias("_named_file"), place.alias("_named_row"))
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "_named_number long, _named_path string")
    both = own.join(few(numbers, len(files)), F.col("_named_file") == F.col("_named_path"), "left")
    number = F.coalesce("_named_number", F.raise_error(F.concat(F.lit("a new file: "), F.col("_named_file"))).cast("long"))
    return both.withColumn(name, F.shiftleft(number, 38).bitwiseOR(F.col("_named_row"))).drop("_named_file", "_named_row", "_named_number", "_named_path")


BROADCAST_ROWS = 100_000


def few(df: DataFrame, n: int) -> DataFrame:
    """df for a join: by a broadcast where its n rows, as counted, are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def running(df: DataFrame, order: list, sums: dict[str, str], n: int, per: int = 100_000) -> DataFrame:
    """df's n rows with position (from 0) and, for each name in sums, the sum of its column over the rows before.

    A window never holds more than about per rows, but for a row per partition: the rows are dealt by ranges of the
    order, which is written to the checkpoint folder, and each partition's totals give the next one's offsets.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    if n <= per:
        w = Window.orderBy(*order)
        return df.select("*", (F.row_number().over(w) - 1).cast("long").alias("position"), *(so_far(c, w).alias(out) for out, c in sums.items()))
    x = cut(df.repartitionByRange(-(-n // per), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    along, inside = Window.orderBy("_part"), Window.partitionBy("_part").orderBy("_at")
    totals = x.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{out}") for out, c in sums.items()))
    offsets = totals.select("_part", so_far("_n", along).alias("_n"), *(so_far(f"_{out}", along).alias(f"_{out}") for out in sums))
    x = x.join(few(offsets, -(-n // per)), "_part")
    return x.select(*df.columns, (F.col("_n") + F.row_number().over(inside) - 1).alias("position"), *((F.col(f"_{out}") + so_far(c, inside)).alias(out) for out, c in sums.items()))


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Arrow hand texts to Python in batches of most bytes: workers of several stages then fit beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batch in runs of about limit bytes of a string column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def by_slice(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES):
    """A function for mapInArrow that applies f to each slice."""

    def run(batches):
        try:
            for batch in batches:
                for part in slices(batch, column, limit):
                    yield f(part)
        finally:
            give_back()

    return run
