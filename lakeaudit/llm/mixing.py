"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the mix takes the point frac(i * golden ratio), which falls to a source through the cumulative targets.
Each source's documents, in an order shuffled by md5, lie end to end and are cut into blocks of equal size; the
k-th slot of a source takes its k-th block, twice round the stream at most, until the source's target is met. So any
stretch of slots holds the sources near their shares, and a document is taken at most twice. Slots that a source lacks
after the schedule (its share is less than a slot, or blocks are cut at the end of a round) follow it, so every source
meets its target to the word.

Running sums never put one source in one task: documents and slots are dealt to buckets, the buckets' totals give
each bucket its offset, and a window runs inside a bucket.

Null text: size 0. Null source: a source of its own, last in order. Repeated rows are documents of their own. An
empty table gives no rows. A document of size 0 has nothing taken.
"""

from __future__ import annotations

import math
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.llm.spark import by_slice, cut, few, named, running, table
from lakeaudit.llm.words import count_words

GOLDEN = 0.6180339887498949
WORD = re.compile("[^\x20\x09-\x0D]+")


def sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with its number of words as size."""
    rest = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(i) for i in range(len(rest))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(count_words(batch.column(len(rest))).astype(np.int64))], [*rest, "size"])

    return docs.select(*rest, text_col).mapInArrow(by_slice(count, text_col), ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "size long"]))


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), per: int = 100_000) -> DataFrame:
    """A row per source: source, rank (from 0), source_size, target.

    target = min(most * size, level * weight), where the level makes the targets add up to share of all sizes: what a
    full source can't take is reshared by weight. Sources may be as many as domains, so none of the running sums over
    them is one task.
    """
    of = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n, total = of.agg(F.count("*"), F.sum("source_size")).first()
    of = running(of, [F.col("source").asc_nulls_last()], {}, n, per).withColumnRenamed("position", "rank")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    of = of.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    of = cut(of.withColumn("ratio", F.col("bound") / F.col("weight")))
    # Sources fill up in order of bound / weight; the level is set by those that are not full.
    every = of.agg(F.sum("weight")).first()[0]
    filled = running(of, ["ratio", "rank"], {"full_bound": "bound", "full_weight": "weight"}, n, per)
    filled = filled.withColumn("level", (F.lit(float(total or 0)) * F.lit(float(share)) - F.col("full_bound")) / (F.lit(every) - F.col("full_weight")))
    first_open = filled.where(F.col("bound") > F.col("level") * F.col("weight")).agg(F.min(F.struct("ratio", "rank", "level"))).first()[0]
    level = F.lit(first_open["level"] if first_open else None).cast("double")
    return of.select("source", "rank", "source_size", F.least("bound", F.coalesce(level * F.col("weight"), F.col("bound"))).alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, size: str, out: str) -> DataFrame:
    """out: the sum of size over the rows before, by keys, then bucket, then order."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("in_bucket"))
    along = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("from", F.coalesce(F.sum("in_bucket").over(along), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(offsets, [*keys, bucket]).withColumn(out, F.col("from") + F.col("inside")).drop("inside", "from")


def streams(sized: DataFrame, sources: DataFrame, n_sources: int, buckets: int) -> DataFrame:
    """sized with rank and at: the words of its source's stream before the document, in the shuffled order."""
    x = sized.join(few(sources, n_sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    x = x.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % buckets)
    return _running(x, ["rank"], "bucket", ["key", "doc_id", "size", *(c for c in ("rid",) if c in sized.columns)], "size", "at")


def schedule(spark: SparkSession, sources: DataFrame, n_sources: int, n_slots: int, per: int = 100_000) -> DataFrame:
    """The mix in order: slot, rank of its source, k (the source's k-th slot, from 0).

    Each point is joined with the interval of cumulative targets that holds it by cells, not by a cross join. Points
    fall evenly, and there are cells enough that few intervals meet in one.
    """
    cells = 4 * max(1024, n_sources)
    whole = sources.agg(F.sum("target")).first()[0] or 1.0
    reach = running(sources, ["rank"], {"lo": "target"}, n_sources, per).withColumn("hi", F.when(F.col("rank") == n_sources - 1, 1.0).otherwise((F.col("lo") + F.col("target")) / whole)).withColumn("lo", F.col("lo") / whole)
    reach = reach.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    slots = slots.join(few(reach, n_sources + cells), "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "rank")
    slots = slots.withColumn("run", F.floor(F.col("slot") / 65536)).withColumn("one", F.lit(1))
    return _running(slots, ["rank"], "run", ["slot"], "one", "k").select("slot", "rank", "k")


def completed(plan: DataFrame, shape: DataFrame, n_sources: int, n_slots: int, block: int, per: int = 100_000) -> DataFrame:
    """plan with the slots, after its n_slots, that sources lack of the blocks up to their goals."""
    rounds = F.floor(F.col("goal") / F.greatest("length", F.lit(1)))
    needed = rounds * F.col("n_blocks") + F.ceil((F.col("goal") - rounds * F.col("length")) / block)
    held = plan.groupBy("rank").agg(F.count("*").alias("held"))
    lack = shape.join(held, "rank", "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("needed", needed).where((F.col("length") > 0) & (F.col("needed") > F.col("held")))
    lack = cut(lack.withColumn("lacking", F.col("needed") - F.col("held")))
    lack = running(lack, ["rank"], {"before": "lacking"}, n_sources, per)
    lack = lack.select("rank", "held", (F.lit(n_slots) + F.col("before")).alias("from"), F.explode(F.sequence("held", F.col("needed") - 1)).alias("k"))
    return plan.unionByName(lack.select((F.col("from") + F.col("k") - F.col("held")).alias("slot"), "rank", "k"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), slots_per_source: int = 4096, slots_per_doc: int = 4, max_block: int = 4096, per: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The documents with what the mix takes of each, and the schedule (slot, rank, block, epoch, words).

    docs: doc_id, source, text and, if the rows have numbers, rid; other columns aren't read. taken: words the mix
    takes; first_pass, second_pass: from its start, in each round of its source's stream. A block holds so many words
    that there are about slots_per_source slots for each source, slots_per_doc for each document where sources are many,
    and max_block words at most.
    """
    spark = docs.sparkSession
    sized = cut(sizes(docs.select(*(c for c in ("rid", "doc_id", "source", "text") if c in docs.columns))))
    sources = cut(targets(sized, share, most, weights, per))
    n_docs, (total, n_sources) = sized.count(), sources.agg(F.sum("target"), F.count("*")).first()
    slots = min(slots_per_source * max(1, n_sources), max(slots_per_source, slots_per_doc * n_docs))
    block = int(min(max_block, max(1, (total or 0) // slots)))
    n_slots = int((total or 0) // block) + 64 + n_sources
    placed = streams(sized, sources, n_sources, max(1, math.isqrt(n_docs)))  # about as many buckets as rows in one
    # A block's words: the block size, but for the last of a round and the last before the target.
    shape = sources.select("rank", F.col("source_size").alias("length"), F.round("target").cast("long").alias("goal"), F.ceil(F.col("source_size") / block).alias("n_blocks"))
    plan = completed(cut(schedule(spark, sources, n_sources, n_slots, per)), shape, n_sources, n_slots, block, per).join(few(shape, n_sources), "rank").where(F.col("n_blocks") > 0)
    plan = plan.withColumn("epoch", F.floor(F.col("k") / F.col("n_blocks"))).withColumn("block", F.col("k") % F.col("n_blocks"))
    start = F.col("epoch") * F.col("length") + F.col("block") * block
    words = F.least(F.lit(block), F.col("length") - F.col("block") * block, F.col("goal") - start)
    plan = plan.withColumn("words", words).where((F.col("words") > 0) & (F.col("epoch") < most)).select("slot", "rank", "block", "epoch", "words")
    # Both sides of the join have a row per block; a document spans few.
    blocks = plan.groupBy("rank", "block").agg(F.sum(F.when(F.col("epoch") == 0, F.col("words")).otherwise(0)).alias("w0"), F.sum(F.when(F.col("epoch") == 1, F.col("words")).otherwise(0)).alias("w1"))
    placed = placed.withColumn("row", F.monotonically_increasing_id())
    placed = cut(placed)
    spans = placed.where(F.col("size") > 0).select("row", "rank", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    overlap = lambda w: F.greatest(F.lit(0), F.least(hi, F.col(w)) - lo)
    got = spans.join(blocks, ["rank", "block"]).groupBy("row").agg(F.sum(overlap("w0")).alias("first_pass"), F.sum(overlap("w1")).alias("second_pass"))
    out = placed.join(got, "row", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("first_pass", "second_pass")})
    return out.withColumn("taken", F.col("first_pass") + F.col("second_pass")).drop("row", "key", "bucket"), plan


def first_words(text: str, n: int) -> str:
    """The text to the end of its n-th word."""
    end = 0
    for m in islice(WORD.finditer(text), n):
        end = m.end()
    return text[:end]


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs, all columns: a row for each time that a document is taken, n_chars (where it is there) of what is taken."""
    own = named(docs, "_rid")
    taken, _ = mix(own.select(F.col("_rid").alias("rid"), "doc_id", "source", "text"), **how)
    passes = taken.select(F.col("rid").alias("_rid"), F.col("size").alias("_size"), F.explode(F.array("first_pass", "second_pass")).alias("_words")).where(F.col("_words") > 0)
    each = own.join(passes, "_rid")
    at, names = docs.columns.index("text"), docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            size, words = (batch.column(len(names) + k).to_numpy() for k in (0, 1))
            cols = [batch.column(k) for k in range(len(names))]
            if len(part := np.flatnonzero(words < size)):
                texts = cols[at].to_pylist()
                for k in part.tolist():
                    texts[k] = first_words(texts[k], int(words[k]))
                cols[at] = pa.array(texts, cols[at].type)
                if chars is not None:
                    whole = pa.array(words == size)
                    cols[chars] = pc.if_else(whole, cols[chars], pc.utf8_length(cols[at]).cast(cols[chars].type))
            yield pa.RecordBatch.from_arrays(cols, names)

    return each.select(*names, "_size", "_words").mapInArrow(run, docs.schema)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


_WEIGHT = "CASE (rank % 3) WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
s1 AS (SELECT *, CAST({_WEIGHT} AS DOUBLE) AS weight, CAST(2.0 AS DOUBLE) * source_size AS bound, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY bound / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s3 AS (SELECT *, (SELECT arg_min(lv, (bound / weight, rank)) FROM s2 WHERE bound > lv * weight) AS level FROM s2),
s AS (SELECT source, rank, source_size, least(bound, coalesce(level * weight, bound)) AS target FROM s3),
goal AS (SELECT *, CAST(round(target) AS BIGINT) AS got FROM s),
p AS (SELECT d.*, g.source_size, g.target, g.got, coalesce(sum(size) OVER (PARTITION BY g.rank ORDER BY CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 7) AS BIGINT) % greatest(1, CAST(floor(sqrt(c)) AS BIGINT)), md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source, (SELECT count(*) AS c FROM d))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(greatest(0, least(size, least(got, source_size) - pos)) + greatest(0, least(size, got - source_size - pos)) AS BIGINT) AS taken FROM p
"""
