"""Exact Jaccard join of documents' word shingles by T-occurrence search (DivideSkip), and its components.

Documents with equal sets are one class; the search runs between classes, each stood for by one row.

A document whose set has n shingles overlaps any partner in T = ceil(percent * n / 100) shingles at least. Its lists are
divided: all but its n - T + need rarest shingles' lists are long and set aside, and a partner must occur at least
``need`` times in the short ones, since each of the T shared shingles that lies past them is one of the T - need
set aside; a pair that needs fewer shared shingles than that needs all of those. Rarity is one global order, from counts over all documents: shingles counted more than ``common`` times come
last. Any order gives the same links; this one keeps short lists short.

1. The short lists are merged in Spark: a sort-merge join by shingle and a count by pair.
2. Pairs with enough occurrences, and whose parity bits leave a link possible, probe the set-aside lists: a binary
   search of one document's shingles in the other's sorted set, in chunks, which ends when the overlap is out of reach.
3. A list of more than ``longest`` documents, which only a large group of near copies has under this order, is never
   paired off. Its documents are first probed against one of them, the hub. Those linked with it are connected already;
   the others are compared, in pairs of blocks bounded in rows and shingles, with each other and with the linked ones.
   A block gives back a forest of its links.

So links between different sets are found all; the result has what they connect. Shingles are compared by 64-bit
hashes, sets by a 128-bit sum over them.

Empty texts, null texts and texts without a word have no shingles and are linked with nothing. A null id is never a
component's name unless the component has no other. Repeated rows and rows with equal ids are nodes each on their own.
Rows are told apart by their place in their file, so it is no matter how the files are cut into partitions when they are read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import words as W
from lakeaudit.llm.components import components
from lakeaudit.llm.spark import by_slice, cut, give_back, named, small_batches, table

HINTS = 500_000  #: common shingles that are broadcast for the order, the most counted first
BROADCAST_IDS = 1_000_000
BLOCK_SHINGLES = 1 << 18
BLOCK_ROWS = 2048
STRIPE = 256
_OTHER = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted sets of hashed shingles end to end, and the n + 1 offsets between them."""
    data, offsets = W.flat(texts)
    data = W.lower(data)
    w = W.words(data, offsets)
    h, n_words = W.word_hash(data, w), np.diff(w.first)
    runs = W.window_hash(h, size)
    sets = []
    for a, n in zip(w.first[:-1].tolist(), n_words.tolist(), strict=True):
        if n >= size:
            keys = np.sort(runs[a : a + n - size + 1])
            sets.append(keys[np.append(True, keys[1:] != keys[:-1])])
        elif n:
            sets.append(W.window_hash(h[a : a + n], n) ^ np.uint64(n))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (running[bounds[1:]] - running[bounds[:-1]]).view(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


class Division:
    """How many of a set's rarest shingles have short lists."""

    def __init__(self, percent: int, need: int):
        self.percent, self.need = percent, need

    def short(self, n: int) -> int:
        overlap = -(-self.percent * n // 100)
        if overlap >= n and n * 100 < self.percent * (n + 1):
            return 0  # no other set is this near
        return n - overlap + min(self.need, overlap)


def short_lists(docs: DataFrame, size: int, division: Division, hints: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """rid, id, n, s1, s2 and short, the rarest shingles: by hash alone, or with the hints' common ones last."""
    id_type = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(hints) if hints is not None else None

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, bounds = shingle_sets(batch.column(2), size)
        n = np.diff(bounds)
        m = np.fromiter(map(division.short, n.tolist()), np.int64, len(n))
        picked = []
        for a, k, b in zip(bounds[:-1].tolist(), m.tolist(), bounds[1:].tolist(), strict=True):
            own = sets[a:b]
            if shared is not None and k and len(shared.value[0]):
                common, count = shared.value
                at = np.minimum(np.searchsorted(common, own[:k]), len(common) - 1)
                if (common[at] == own[:k]).any():
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.lexsort((own, np.where(common[at] == own, count[at], 0)))]
            picked.append(own[:k])
        short = _lists(np.concatenate([*picked, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(m)]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(_sums(W.mix(sets), bounds)), pa.array(_sums(W.mix(sets ^ _OTHER), bounds)), short], ["rid", "id", "n", "s1", "s2", "short"])

    return docs.select("rid", "id", "text").mapInArrow(by_slice(make), f"rid long, id {id_type}, n long, s1 long, s2 long, short array<long>")


def parity(keys: np.ndarray) -> np.ndarray:
    """One bit for each of 2 ** k residues, 64 or as many as keys: whether an odd number of keys falls there."""
    bits = max(64, 1 << max(0, len(keys) - 1).bit_length())
    return np.packbits(np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """rid, n, shingles (sorted) and their parity bits."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, bounds = shingle_sets(batch.column(1), size)
        bits = [parity(sets[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        odd = _lists(np.concatenate([*bits, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(b) for b in bits], dtype=np.int64)]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), _lists(sets, bounds), odd], ["rid", "n", "shingles", "odd"])

    return docs.select("rid", "text").mapInArrow(by_slice(make), "rid long, n long, shingles array<long>, odd array<long>")


def required(a: int, b: int, percent: int) -> int:
    """The overlap that links sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def may_link(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    """Whether parity bits leave a link possible: each differing bit stands for a shingle that one set lacks."""
    while len(a) > len(b):
        a = a.reshape(2, -1)
        a = a[0] ^ a[1]
    while len(b) > len(a):
        b = b.reshape(2, -1)
        b = b[0] ^ b[1]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= n_a + n_b - 2 * required(n_a, n_b, percent)


def probe(a: np.ndarray, b: np.ndarray, percent: int, chunk: int = 512) -> bool:
    """Whether two sorted sets overlap enough: binary searches of a's shingles in b, until that is out of reach."""
    least, found = required(len(a), len(b), percent), 0
    for lo in range(0, len(a), chunk):
        part = a[lo : lo + chunk]
        at = np.searchsorted(b, part)
        found += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        if found + len(a) - lo - len(part) < least:
            return False
    return found >= least


def _pairs_where(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose rows of sets pass test(values, n, values, n). Run at once, in small Arrow batches, as sets may be long."""

    def run(batches):
        for batch in batches:
            (xv, xo), (yv, yo) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(4), batch.column(5)))
            m, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [test(xv[xo[i] : xo[i + 1]], m[i], yv[yo[i] : yo[i + 1]], n[i]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("rid").alias(k), F.col("n").alias(f"n_{k}"), F.col(column).alias(f"{k}_values")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "a_values", "b_values")
    conf, key = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = conf.get(key)
    conf.set(key, "64")
    try:
        return cut(both.mapInArrow(run, "a long, b long"))
    finally:
        conf.set(key, rows)


def probe_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: parity bits rule most others out before whole sets are brought together."""
    near = _pairs_where(pairs, sets, "odd", lambda a, m, b, n: may_link(a, m, b, n, percent))
    return _pairs_where(near, sets, "shingles", lambda a, m, b, n: probe(a.view(np.uint64), b.view(np.uint64), percent))


def rows_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df's rows whose rid is in ids (distinct): by a broadcast where ids are few, as counted, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rid", "left_semi")


def block_links(asks: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int, width: int = 1024) -> list[tuple[int, int]]:
    """A forest of the links between the rows that ask and all rows of a block; overlaps are counted list by list.

    Counts stay below 2 ** 24, so float32 holds them exactly. Memory goes with the square of the rows, which
    BLOCK_ROWS bounds.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, token, count = np.unique(tokens, return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    keep = count[token] > 1
    row, token = row[keep], common[token[keep]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    own = np.flatnonzero(asks)
    overlap = np.zeros((len(own), len(sizes)), np.float32)
    lists = np.zeros((len(sizes), width), np.float32)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        lists[:] = 0
        lists[row[a:b], token[a:b] - lo] = 1
        for at in range(0, len(own), STRIPE):  # the product of a stripe alone is held beside the counts
            overlap[at : at + STRIPE] += lists[own[at : at + STRIPE]] @ lists.T
    label, found = np.arange(len(sizes)), []
    for k, i in enumerate(own.tolist()):
        near = np.flatnonzero(overlap[k] * (100 + percent) >= percent * (sizes[i] + sizes))
        groups, first = np.unique(label[near], return_index=True)
        for g, j in zip(groups.tolist(), near[first].tolist(), strict=True):
            if g != label[i]:
                found.append((i, j))
                label[label == g] = label[i]
    return found


def long_list_links(groups: DataFrame, sets: DataFrame, hub_links: DataFrame, percent: int) -> DataFrame:
    """groups: hub, rid, n. Links of rows that their hub isn't linked with, as a, b."""
    linked = hub_links.select(F.col("a").alias("hub"), F.col("b").alias("rid"), F.lit(True).alias("linked"))
    own = groups.where(F.col("rid") != F.col("hub")).join(linked, ["hub", "rid"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    blocks = lambda linked: F.greatest(F.ceil(F.sum(F.when(F.col("linked") == linked, F.col("n"))) / BLOCK_SHINGLES), F.ceil(F.count_if(F.col("linked") == linked) / BLOCK_ROWS))
    per = own.groupBy("hub").agg(F.coalesce(blocks(False), F.lit(0)).alias("n_open"), F.coalesce(blocks(True), F.lit(0)).alias("n_linked"), F.count_if(~F.col("linked")).alias("open")).where(F.col("open") > 0)
    own = own.join(per, "hub").withColumn("block", F.pmod(F.xxhash64("rid"), F.when(F.col("linked"), F.col("n_linked")).otherwise(F.col("n_open"))))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<long>"))
    with_open = F.transform(upto("n_open"), lambda j: F.struct(F.lit(0).alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    with_linked = F.transform(upto("n_linked"), lambda j: F.struct(F.lit(1).alias("kind"), F.col("block").alias("i"), j.alias("j")))
    as_linked = F.transform(upto("n_open"), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("block").alias("j")))
    dealt = own.select("hub", "rid", "linked", F.explode(F.when(F.col("linked"), as_linked).otherwise(F.concat(with_open, with_linked))).alias("pair"))
    dealt = dealt.select(F.xxhash64("hub", "pair").alias("task"), "rid", "linked").join(sets, "rid")

    def run(part: pa.Table) -> pa.Table:
        rid, asks = part.column("rid").to_numpy(), ~part.column("linked").to_numpy()
        shingles = part.column("shingles").combine_chunks()
        found = block_links(asks, np.diff(shingles.offsets.to_numpy()), shingles.flatten().to_numpy(zero_copy_only=False), percent)
        x, y = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        give_back()
        return pa.table([rid[x], rid[y]], ["a", "b"])

    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, need: int = 3, common: int = 4, longest: int = 64) -> DataFrame:
    """rid, id, n_shingles, component_id (the smallest id that links reach), stays (one row of each component). A row per row of docs.

    docs needs rid, an id that no two rows share and that a row keeps when it is read again (named()).
    """
    own = docs.select("rid", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    division = Division(percent, need)
    rows = cut(short_lists(own, size, division, None))
    key = ["s1", "s2", "n"]
    name = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")
    classes = cut(rows.where(F.col("n") > 0).groupBy(*key).agg(F.min("rid").alias("rep"), F.min(name).alias("name"), F.count("*").alias("copies")))
    reps = classes.select(F.col("rep").alias("rid"))
    # Common shingles, as counted over every class's rarest by hash; the order they give is only a hint.
    counted = rows_of(rows, reps).select(F.explode("short").alias("shingle")).groupBy("shingle").count().where(F.col("count") > common)
    hints = counted.orderBy(F.desc("count"), "shingle").limit(HINTS).toPandas()
    tokens = hints["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    short = short_lists(own, size, division, (tokens[order], hints["count"].to_numpy()[order])).select("rid", "n", "short")
    postings = cut(rows_of(short, reps)).select(F.explode("short").alias("shingle"), "rid", F.col("n").cast("int").alias("n"))
    per_list = postings.groupBy("shingle").agg(F.count("*").alias("m"), F.min("rid").alias("hub")).where(F.col("m") > 1)
    shared = cut(postings.join(per_list, "shingle"))
    short = shared.where(F.col("m") <= longest).select("shingle", "rid", "n")
    x, y = (short.select("shingle", F.col("rid").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    near = (F.col("a") < F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    overlap = F.ceil(percent * (F.col("n_a").cast("long") + F.col("n_b")) / (100 + percent))
    pairs = x.join(y, "shingle").where(near).groupBy("a", "b", "n_a", "n_b").count().where(F.col("count") >= F.least(F.lit(need), overlap)).select("a", "b")
    groups = cut(shared.where(F.col("m") > longest).select("hub", "rid", "n").distinct())
    # A pair that shares both short and long lists may have too few short ones: it counts as a pair of the hub's group.
    stars = groups.where(F.col("rid") != F.col("hub")).select(F.col("hub").alias("a"), F.col("rid").alias("b"))
    pairs = cut(pairs.unionByName(stars).distinct())
    wanted = cut(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct())
    sets = cut(whole_sets(rows_of(own.select("rid", "text"), wanted), size))
    links = probe_pairs(pairs, sets, percent)
    if not groups.isEmpty():
        links = links.unionByName(long_list_links(groups, sets, links, percent))
    labels = components(links)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").withColumn("label", F.coalesce("label", "rep"))
    best = named.groupBy("label").agg(F.min("name").alias("best"), F.sum("copies").alias("members"))
    found = named.join(best, "label").where(F.col("members") > 1).select(*key, "best")
    alone = F.col("best").isNull()
    out = rows.drop("short").join(found, key, "left")
    return out.select("rid", "id", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"), (alone | (F.col("rid") == F.col("best.rid"))).alias("stays"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, but of each component of near copies one: the row of its smallest id."""
    own = named(docs, "_rid")
    gone = jaccard_join(own.select(F.col("_rid").alias("rid"), "doc_id", "text"), **how).where(~F.col("stays")).select(F.col("rid").alias("_rid"))
    return own.join(gone, "_rid", "left_anti").select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = named(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return jaccard_join(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
