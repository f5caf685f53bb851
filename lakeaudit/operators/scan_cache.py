"""A stored table of scanned contents: a run scans only contents that it lacks, and no content is ever shuffled.

An entry is (content_sha256, kind, rules, hits): kind is the language and the file name's extension, by which rules are
chosen; rules a hash of the rule list; hits an array, empty where nothing was found. A run hashes all files, and what is
shuffled is hashes and paths. One file stands for each new content. Those files' contents are found while the corpus is
read: a Bloom filter of their names, made in this run and bounded in size, lets few others through, and what others
find is dropped by an exact join of the hits, which are small. The run's hits are the stored and the fresh entries joined
with the files by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lakeaudit.functions.session import cut

#: Bits of the filter at most: 8 MB on the driver and in each worker. Beyond about a sixth of them in files, more contents pass in vain.
FILTER_BITS = 1 << 26
SEEDS = (11, 23, 47)
KEY = ["content_sha256", "kind"]


def rules_hash(rules) -> str:
    """A name for a rule list: entries of another list don't count."""
    return hashlib.sha256(repr(sorted(rules, key=lambda r: r.rule_id)).encode()).hexdigest()


def file_kind(language: Column, path: Column) -> Column:
    return F.concat_ws("|", F.coalesce(language, F.lit("")), F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1))


def hashed(corpus: DataFrame) -> DataFrame:
    """project_id, path, language, content_sha256, kind: what a run shuffles of its files."""
    return corpus.select("project_id", "path", "language", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"), file_kind(F.col("language"), F.col("path")).alias("kind"))


def _places(bits: int) -> Column:
    """Where a file's name sets its bits."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("project_id").cast("string"), F.lit("")), F.coalesce("path", F.lit(""))), F.lit(bits)) for seed in SEEDS))


def bloom_filter(files: DataFrame, bits: int) -> np.ndarray:
    """The set bits of all files' names, or-ed together in Spark: one row for each word of 32 bits reaches the driver at most."""
    words = files.select(F.explode(_places(bits)).alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 AS int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def may_hold(files: DataFrame, chosen: np.ndarray) -> DataFrame:
    """The files whose names the filter has, and a few others. Their contents don't go to Python for it."""
    shared, bits = files.sparkSession.sparkContext.broadcast(chosen), len(chosen) * 32

    @F.pandas_udf(BooleanType())
    def held(places: pd.Series) -> pd.Series:
        at = np.array(places.tolist(), np.int64).reshape(len(places), len(SEEDS))
        return pd.Series(((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=1))

    return files.where(held(_places(bits)))


def scan_cached(corpus: DataFrame, scan, rules: str, cache: DataFrame | None = None, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits of every file, fresh entries to append to the cache).

    scan: DataFrame to DataFrame of hits with project_id and path, and whatever describes a hit, by content, language and
    extension alone. cache: entries of earlier runs, of any rules. The hits have project_id, path, language and what scan adds.
    Files of equal content and kind are scanned once, whichever project they are in; null contents count as empty.
    """
    files = cut(hashed(corpus))
    lacking = files.groupBy(*KEY).agg(F.min(F.struct("project_id", "path")).alias("file"))
    if cache is not None:
        known = cache.where(F.col("rules") == rules)
        lacking = lacking.join(known.select(*KEY), KEY, "left_anti")
    lacking = cut(lacking.select(*KEY, F.col("file.project_id").alias("project_id"), F.col("file.path").alias("path")))
    n = lacking.count()
    bits = bits or min(FILTER_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    found = scan(may_hold(corpus, bloom_filter(lacking, bits)))
    details = [c for c in found.columns if c not in ("project_id", "path", "language")]
    ours = lacking.withColumnsRenamed({"project_id": "_project", "path": "_path"})
    per = found.join(ours, F.col("project_id").eqNullSafe(F.col("_project")) & F.col("path").eqNullSafe(F.col("_path"))).groupBy(*KEY).agg(F.collect_list(F.struct(*details)).alias("hits"))
    empty = F.array().cast(per.schema["hits"].dataType)
    fresh = cut(lacking.select(*KEY).join(per, KEY, "left").select(*KEY, F.lit(rules).alias("rules"), F.coalesce("hits", empty).alias("hits")))
    entries = fresh if cache is None else fresh.unionByName(known.select(*fresh.columns))
    hits = files.join(entries.where(F.size("hits") > 0), KEY).select("project_id", "path", "language", F.explode("hits").alias("hit")).select("project_id", "path", "language", "hit.*")
    return hits, fresh
