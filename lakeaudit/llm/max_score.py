"""Exact top-k inner products by MaxScore over shards of the vectors.

A vector's components are its terms. In a shard, a term's bound for a query is the largest product that any vector there
can add. Terms are split by their bounds: the non-essential ones together can't lift a vector to the query's current
k-th score. The essential ones are summed for all vectors; the others are probed, a few terms at a time, only for
vectors whose sum and what bounds remain can still compete. The shards' best are merged by rank.

Queries are dealt to blocks and vectors to shards, both of bounded size; a task gets one block and one shard. So every
query meets every vector, and no task or broadcast grows with the data.

Components become floor(1024 * x), x as double. A shard's products are summed as float64 where its largest ones keep sums
exact, else as 64-bit numbers, else as Python's unbounded ones: scores are exact at any size. The result's score is a
long, so one of the best that doesn't fit is an error. Vectors null or holding a null or non-finite component, and rows
without an id, take no part. A shorter vector counts as 0 where it ends, so an empty one scores 0. Rows with the query's
own id are no candidates of it; other repeated rows are candidates each on their own, and a repeated query row is a query
of its own.
An empty table, or one without queries, gives no rows; labels and other columns aren't read.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import nsmallest
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakeaudit.llm.spark import table

EXACT = 2.0**53
CHUNK = 1024


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, score, id) triples, the k best of each query, in order."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], score[keep], ids[keep]


def max_score(query: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, step: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of query, score, id) of each query's k best in a shard. Whole numbers as float64, or int64 where those aren't exact."""
    high, low = x.max(0), x.min(0)
    bound = np.maximum(query * high, query * low)
    terms = np.argsort(-np.abs(bound).mean(0), kind="stable")
    query, x, bound = np.ascontiguousarray(query[:, terms]), np.ascontiguousarray(x[:, terms]), bound[:, terms]
    rest = np.concatenate([np.cumsum(bound[:, ::-1], axis=1)[:, ::-1], np.zeros((len(query), 1), bound.dtype)], axis=1)
    least = np.full(len(query), np.iinfo(np.int64).min // 4, x.dtype)
    got = (np.zeros(0, np.int64), np.zeros(0, x.dtype), np.zeros(0, np.int64))
    for a in range(0, len(x), CHUNK):
        part, own = x[a : a + CHUNK], ids[a : a + CHUNK]
        # The essential terms of the block: past them, what is left can't reach the k-th score of half the queries.
        reach = np.flatnonzero(np.median(rest - np.maximum(least, 0)[:, None], axis=0) <= 0)
        m = max(step, int(reach[0])) if len(reach) and a else x.shape[1]
        total = query[:, :m] @ part[:, :m].T
        qi, xi = np.nonzero((total + rest[:, m, None] >= least[:, None]) & (query_ids[:, None] != own[None, :]))
        sums = total[qi, xi]
        for lo in range(m, x.shape[1], step):
            sums = sums + (query[qi, lo : lo + step] * part[xi, lo : lo + step]).sum(1)
            alive = sums + rest[qi, min(lo + step, x.shape[1])] >= least[qi]
            qi, xi, sums = qi[alive], xi[alive], sums[alive]
        got = _best(np.append(got[0], qi), np.append(got[1], sums), np.append(got[2], own[xi]), k)
        ends = np.searchsorted(got[0], np.arange(len(query)), "right") - 1
        full = np.bincount(got[0], minlength=len(query)) >= k
        least[full] = got[1][ends[full]]
    return got


def every_score(query: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As max_score, for whole numbers of any size (arrays of Python's): without bounds, a few vectors at a time."""
    got: list[list[tuple[int, int]]] = [[] for _ in query]
    for a in range(0, len(x), 64):
        total = query @ x[a : a + 64].T
        for i, row in enumerate(total):
            new = [(-int(v), int(own)) for v, own in zip(row, ids[a : a + 64], strict=True) if own != query_ids[i]]
            got[i] = nsmallest(k, got[i] + new)
    best = [(i, -v, own) for i, found in enumerate(got) for v, own in found]
    if any(not -(2**63) <= v < 2**63 for _, v, _ in best):
        raise OverflowError("a score doesn't fit in 64 bits")
    return tuple(np.array([b[c] for b in best], np.int64) for c in range(3))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def _width(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, shard_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), id, score for every row of which is_query holds."""
    whole = vectors.where(F.col(id_col).isNotNull())
    whole = whole.where(~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    whole = whole.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
    counts = whole.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-counts[0] // shard_rows)), max(1, -(-counts[1] // block_rows))
    row = F.monotonically_increasing_id()
    numbered = whole.withColumn("row", row)
    key = F.xxhash64("row")
    x = numbered.select("id", "v", F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = numbered.where("asks").select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), "row", F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "query_id", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        width = max(_width(left.column("q_v")), _width(right.column("v")))
        both = [_matrix(left.column("q_v"), width), _matrix(right.column("v"), width)]
        with np.errstate(over="ignore"):
            scaled = [np.floor(m * scale) for m in both]
            most = float(np.abs(scaled[0]).max(initial=0)) * float(np.abs(scaled[1]).max(initial=0)) * width
        query_ids, ids = left.column("q_id").to_numpy(), right.column("id").to_numpy()
        if most < EXACT / 4:
            at, score, ids = max_score(scaled[0], query_ids, scaled[1], ids, k)
        elif most < EXACT * 128 and max(float(np.abs(m).max(initial=0)) for m in scaled) < EXACT:
            at, score, ids = max_score(scaled[0].astype(np.int64), query_ids, scaled[1].astype(np.int64), ids, k)
        else:
            whole = [np.array([[floor(Fraction(v) * Fraction(scale)) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in both]
            at, score, ids = every_score(whole[0], query_ids, whole[1], ids, k)
        return pa.table([left.column("row").to_numpy()[at], query_ids[at], ids, score.astype(np.int64)], names)

    found = q.groupBy("block", "shard").cogroup(x.groupBy("block", "shard")).applyInArrow(search, "row long, query_id long, id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""
