"""Shards of near equal bytes by a k-d tree over the documents' metadata, in DataFrame functions only.

A document's metadata are coordinates: the hash of its source, the hash of its language (equal names meet in one place of
the axis, however many names there are) and the logarithm of its size. A node of the tree that stands for m shards is cut
along the dimension in which its documents spread widest, at the weighted median: the place that leaves bytes in
proportion to m // 2 shards below it. The leaves are the shards, each at the target of total / shards bytes.

A key is a coordinate, then a hash of the text, one of the row's contents and one of its number, so a cut may run through a
hot source, or through a group of copies, and is as near the median as elsewhere: equal texts of one source and
language lie side by side, and are parted only where a cut falls among them. The median is found without
a sort: bytes are summed in 1024 ranges of each node's keys, the range that holds the median is divided again, until
it is narrow enough, for all nodes of a level at once. A pass reads narrow rows, written to the checkpoint folder once;
bytes are summed before the shuffle, and the driver gets at most 1024 sums a node.

bytes is the law: |bytes of a shard - target| is at most about the size of the documents where cuts fall, so a document
larger than the target is a shard with little else. Null text: 16 bytes. Null source or language: a place of its own on
the axis. Rows equal in all columns are told apart by their row number, which is written before it is used. A null
doc_id is a value like others. An empty table gives no rows; fewer documents than shards leave shards empty. Very long
texts are measured by the JVM and go nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.spark import cut, running, table

#: Bits of a key: the coordinate, then hashes of the text, of the row's contents and of its number.
VALUE_BITS, COPY_BITS, ID_BITS, ROW_BITS = 14, 20, 20, 9
LOW_BITS = COPY_BITS + ID_BITS + ROW_BITS
#: Ranges of a node whose bytes are summed in a pass; a power of two.
RANGES = 1024


@dataclass(frozen=True)
class Node:
    """Shards from first on; cut: keys of the dimension less than it go to the left."""

    first: int
    shards: int
    dimension: str | None = None
    cut: int | None = None


def _bits(value: Column, n: int) -> Column:
    """The upper n bits of a 64-bit hash."""
    return F.shiftrightunsigned(value, 64 - n)


def place(name: Column) -> Column:
    """A name's place on an axis of VALUE_BITS bits; null has 0."""
    return F.when(name.isNull(), F.lit(0)).otherwise(_bits(F.xxhash64(name), VALUE_BITS)).cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("source", "lang"), overhead: int = 16) -> DataFrame:
    """id, size, text_crc32 and a key for each dimension of every row; the texts stay behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = {f"key_{i}": place(F.col(c)) for i, c in enumerate(names)}
    x = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), *(c.alias(n) for n, c in at.items()), F.monotonically_increasing_id().alias("row"))
    at = [F.col(n) for n in at] + [F.floor(F.log2("size") / 64 * (1 << VALUE_BITS))]
    copy, own, row = _bits(F.xxhash64("text_crc32", "size"), COPY_BITS), _bits(F.xxhash64("id", "text_crc32", *at), ID_BITS), _bits(F.xxhash64("row"), ROW_BITS)
    low = F.shiftleft(copy, ID_BITS + ROW_BITS).bitwiseOR(F.shiftleft(own, ROW_BITS)).bitwiseOR(row)
    return x.select("id", "size", "text_crc32", *(F.shiftleft(c, LOW_BITS).bitwiseOR(low).alias(f"key_{i}") for i, c in enumerate(at)))


def _leaf(tree: dict[int, Node], value, number: int = 1) -> Column:
    """value(number, node) of the lowest node of the tree that a row is in; a node's children are twice its number, and one more."""
    node = tree[number]
    if node.cut is None:
        return F.lit(value(number, node))
    return F.when(F.col(node.dimension) < node.cut, _leaf(tree, value, 2 * number)).otherwise(_leaf(tree, value, 2 * number + 1))


def _of(values: dict[int, float], kind: str, key: str = "node") -> Column:
    """The value of the number in column key."""
    return F.element_at(F.create_map(*(F.lit(v).cast(t) for n, x in values.items() for v, t in ((n, "int"), (x, kind)))), F.col(key))


def _widest(keys: DataFrame, dimensions: list[str]) -> dict[int, tuple[str, int, int, int]]:
    """Of each node: the dimension of the greatest extent, its least and greatest key, and the node's bytes."""
    found = keys.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    out = {}
    for r in found:
        d = max(dimensions, key=lambda d: (r[f"hi_{d}"] >> LOW_BITS) - (r[f"lo_{d}"] >> LOW_BITS))
        out[r["node"]] = (d, r[f"lo_{d}"], r[f"hi_{d}"], r["bytes"])
    return out


def _medians(keys: DataFrame, part: dict[int, float], within: dict[int, tuple[str, int, int, int]], close: dict[int, float]) -> dict[int, int]:
    """The key of each node that leaves the given part of its bytes below it, by ever narrower ranges of keys.

    The driver gets at most RANGES sums a node and pass. A node is done when the range that holds its median has one
    key, or at most close bytes; ranges of at most RANGES rows are summed by single keys.
    """
    dimensions = {d: [n for n, w in within.items() if w[0] == d] for d in {w[0] for w in within.values()}}
    key = F.coalesce(*(F.when(F.col("node").isin(nodes), F.col(d)) for d, nodes in dimensions.items()))
    lo, hi, goal, shift = {}, {}, {}, {}
    for n, (_, least, most, size) in within.items():
        lo[n], hi[n], goal[n], shift[n] = least, most, size * part[n], max(0, (most - least).bit_length() - RANGES.bit_length() + 1)
    cuts: dict[int, int] = {}
    while lo:
        x = keys.where(F.col("node").isin(list(lo))).select("node", "size", key.alias("key"), _of(lo, "long").alias("lo"), _of(hi, "long").alias("hi"), _of(shift, "int").alias("by"))
        x = x.where(F.col("key").between(F.col("lo"), F.col("hi"))).select("node", "size", "key", F.expr("shiftright(key - lo, by)").alias("range"))
        sums = x.groupBy("node", "range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        for n in list(lo):
            before = 0
            for r in sorted((r for r in sums if r["node"] == n), key=lambda r: r["range"]):
                if before + r["bytes"] >= goal[n]:
                    break
                before += r["bytes"]
            if r["least"] == r["most"] or r["bytes"] <= close[n]:  # the nearer end of the range
                cuts[n] = r["most"] + 1 if goal[n] - before > r["bytes"] / 2 else r["least"]
                del lo[n]
            else:
                goal[n] -= before
                lo[n], hi[n] = r["least"], r["most"]
                shift[n] = 0 if r["rows"] <= RANGES else max(0, (hi[n] - lo[n]).bit_length() - RANGES.bit_length() + 1)
    return cuts


def tree(keys: DataFrame, shards: int, close: float = 1e-4) -> dict[int, Node]:
    """The k-d tree by node numbers, for keys as keyed() gives them. close: how near a cut must be, as a part of a shard's target."""
    dimensions = [c for c in keys.columns if c.startswith("key_")]
    out = {1: Node(0, shards)}
    level = dict(out) if shards > 1 else {}
    while level:
        here = keys.withColumn("node", _leaf(out, lambda number, _: number)).where(F.col("node").isin(list(level)))
        within = _widest(here, dimensions)
        cuts = _medians(here, {n: node.shards // 2 / node.shards for n, node in level.items()}, within, {n: close * w[3] / level[n].shards for n, w in within.items()})
        below: dict[int, Node] = {}
        for n, node in level.items():
            left = node.shards // 2
            out[n] = Node(node.first, node.shards, within[n][0] if n in within else dimensions[0], cuts.get(n, 0))
            below |= {2 * n: Node(node.first, left), 2 * n + 1: Node(node.first + left, node.shards - left)}
        out |= below
        level = {n: node for n, node in below.items() if node.shards > 1}
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("source", "lang"), per: int = 100_000) -> DataFrame:
    """id_col, size, text_crc32, shard and slot (from 0 in its shard, without a gap) of every row of docs."""
    keys = cut(keyed(docs, id_col, text_col, names))
    dealt = keys.withColumn("shard", _leaf(tree(keys, shards), lambda _, node: node.first))
    counts = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    starts = {s: sum(n for t, n in counts.items() if t < s) for s in range(shards)}
    placed = running(dealt, ["shard", F.shiftright("key_0", ROW_BITS), "id", "text_crc32"], {}, sum(counts.values()), per)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("position") - _of(starts, "long", "shard")).alias("slot"))


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
