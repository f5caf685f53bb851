"""A Merkle manifest of a table: a tree per source over its rows in order, and a tree over the sources.

Leaves are sorted by source and id into partitions, and each gets its index in its source. A partition walks its leaves
with a mountain-range stack: a leaf is pushed at level 0, and whenever the last `fanout` nodes of a level are a whole,
aligned run, they carry into one node of the next level. What is left on the stack are the completed peaks. A run
that begins or ends in another partition doesn't carry: its nodes are the edges of the partition, a few for each level. The
last run of a level is hashed as short as it is, without padding, where a source's end is known. Edges are merged in
blocks of `fanout` to a power leaves, each block one node again, until a source is one node; so no group holds more than
the edges of the partitions that meet in a block.

A proof needs the siblings of a leaf's run at each level. Those inside the leaf's partition are rebuilt by the same stack;
those outside are the siblings of the nodes at the ends of the partition's stretch of a source, looked up among edges and
merged nodes: a few for each level. The tree over the sources is made in the same way, and a source's own siblings there
end the proof of each of its leaves.

Digests are sha256 of the concatenated hex digests of a run; a lone node stays as it is. A null column is "-" in a leaf.
Null source: a source of its own, first. Null ids come first; rows of equal ids are in order of their leaves, and rows
equal in the five columns have equal leaves, so which is which makes no difference. An empty table gives no rows. Texts, however long,
are hashed by the JVM and go nowhere. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.llm.spark import cut, few, table

NODES = "tree string, n long, level int, idx long, digest string"
#: Highest level of a tree whose number of leaves is a long.
MOST_LEVELS = 39


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*(framed(v) for v in values)), "utf-8"), 256)


def _powers(fanout: int) -> list[int]:
    return [fanout**k for k in range(MOST_LEVELS + 1) if fanout**k < 1 << 62]


def _depth(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in _powers(fanout))), lambda p: p < n))


def indexed(leaves: DataFrame, order: list, per: int) -> tuple[DataFrame, DataFrame]:
    """The leaves (tree, never null, leaf, and other columns) in order inside each tree, with part, idx (from 0 in the
    tree) and n (the tree's leaves); and the stretches of trees in parts: part, tree, first, here, n."""
    leaves = cut(leaves)
    parts = max(1, -(-leaves.count() // per))
    x = cut(leaves.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()))
    x = x.withColumn("part", F.shiftright("_at", 33).cast("int"))
    inside = cut(x.groupBy("part", "tree").agg(F.count("*").alias("here"), F.min("_at").alias("_from")))
    n = inside.count()
    before = F.sum("here").over(Window.partitionBy("tree").orderBy("part")) - F.col("here")
    stretches = cut(inside.withColumn("first", before).join(few(inside.groupBy("tree").agg(F.sum("here").alias("n")), n), "tree"))
    x = x.join(few(stretches.select("part", "tree", "first", "_from", "n"), n), ["part", "tree"]).withColumn("idx", F.col("first") + F.col("_at") - F.col("_from"))
    return x.drop("_at", "_from", "first"), stretches.select("part", "tree", "first", "here", "n")


class Range:
    """A mountain-range stack over neighbouring leaves of a tree of n leaves.

    peaks: by level, the nodes whose run isn't whole here. done: the nodes that runs carried into, and leaves, by level.
    """

    def __init__(self, n: int, fanout: int):
        self.fanout, self.widths = fanout, [n]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fanout))
        self.peaks: list[list[tuple[int, str]]] = [[] for _ in self.widths]
        self.done: list[dict[int, str]] = [{} for _ in self.widths]

    def push(self, idx: int, node: str) -> None:
        """The leaf after the last one; carries as far as runs are whole."""
        for level, peaks in enumerate(self.peaks):
            peaks.append((idx, node))
            self.done[level][idx] = node
            first = idx - idx % self.fanout
            size = min(self.fanout, self.widths[level] - first)
            if level + 1 == len(self.widths) or idx != first + size - 1 or len(peaks) < size or peaks[-size][0] != first:
                return
            node, idx = digest([d for _, d in peaks[-size:]]), idx // self.fanout
            del peaks[-size:]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_NODES = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])


def peaks(leaves: DataFrame, fanout: int, inner: bool = False) -> DataFrame:
    """The nodes that the stretches leave, completed peaks and edges; or, if inner, those above the leaves that they carried into."""

    def walk(batches):
        now, last, n, stack, out = None, None, 0, None, []

        def closed():
            if stack:
                found = ((level, i, d) for level, row in enumerate(stack.done) if level for i, d in row.items()) if inner else ((level, i, d) for level, row in enumerate(stack.peaks) for i, d in row)
                out.extend((now, n, *node) for node in found)

        for batch in batches:
            for tree, idx, size, d in zip(*(batch.column(c).to_pylist() for c in ("tree", "idx", "n", "leaf")), strict=True):
                if tree != now or idx != last + 1:
                    closed()
                    now, n, stack = tree, size, Range(size, fanout)
                stack.push(idx, d)
                last = idx
            if len(out) > 10_000:
                yield _batch(out, _NODES)
                out.clear()
        closed()
        yield _batch(out, _NODES)

    return leaves.select("part", "tree", "idx", "n", "leaf").sortWithinPartitions("part", "tree", "idx").mapInArrow(walk, NODES)


def _merge(fanout: int, low: int, high: int) -> Callable[[pa.Table], pa.Table]:
    """Carry one block's nodes of levels low to high - 1 as far as their runs are whole."""

    def merge(table: pa.Table) -> pa.Table:
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        widths = Range(n, fanout).widths
        ready: dict[int, dict[int, str]] = {level: {} for level in range(low, high + 1)}
        for level, idx, d in zip(*(table.column(c).to_pylist() for c in ("level", "idx", "digest")), strict=True):
            ready[level][idx] = d
        out = []
        for level in range(low, min(high, len(widths) - 1)):
            for run, idx in groupby(sorted(ready[level]), key=lambda i: i // fanout):
                held = list(idx)
                if len(held) == min(fanout, widths[level] - run * fanout):
                    ready[level + 1][run] = digest([ready[level][i] for i in held])
                    out.append((tree, n, level + 1, run, ready[level + 1][run]))
        return pa.Table.from_batches([_batch(out, _NODES)])

    return merge


def merged(edges: DataFrame, fanout: int, rise: int = 6) -> DataFrame:
    """edges and the nodes that they complete, up to each tree's root.

    Blocks of fanout ** rise leaves become one node each, then blocks of so many of those: a group holds two nodes for each at most.
    """
    found = cut(edges)
    most, low = found.agg(F.max("n")).first()[0] or 1, 0
    powers = F.array(*(F.lit(p).cast("long") for p in _powers(fanout)))
    while fanout**low < most:
        high = low + rise
        reach = F.element_at(F.array(*(F.lit(fanout**k).cast("long") for k in range(rise, 0, -1))), F.col("level") - low + 1)
        unfinished = found.where((F.col("level") >= low) & (F.col("level") < high) & (F.get(powers, F.col("level")) < F.col("n")))
        fresh = unfinished.withColumn("block", F.floor(F.col("idx") / reach)).groupBy("tree", "block").applyInArrow(_merge(fanout, low, high), NODES)
        found, low = cut(found.unionByName(fresh)), high
    return found


@dataclass(frozen=True)
class Trees:
    """leaves and stretches as indexed() gives them; nodes as merged() does; roots: tree, digest."""

    leaves: DataFrame
    stretches: DataFrame
    nodes: DataFrame
    roots: DataFrame
    fanout: int

    def every_node(self) -> DataFrame:
        """tree, n, level, idx, digest of all nodes above the leaves: what a stored manifest holds."""
        return peaks(self.leaves, self.fanout, inner=True).unionByName(self.nodes.where("level > 0")).dropDuplicates(["tree", "level", "idx"])

    def outside(self) -> DataFrame:
        """part, tree, level, idx, digest: what a part lacks to prove its leaves, the other nodes of the runs at the ends of its stretches."""
        split = self.stretches.where(F.col("here") < F.col("n"))
        at = split.select("part", "tree", "n", F.explode(F.array("first", F.col("first") + F.col("here") - 1)).alias("at"), _depth(F.col("n"), self.fanout).alias("depth"))
        at = at.select("part", "tree", "at", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level"))
        run = F.floor(F.col("at") / F.element_at(F.array(*(F.lit(p).cast("long") for p in _powers(self.fanout)[1:])), F.col("level") + 1))
        wanted = at.select("part", "tree", "level", F.explode(F.sequence(run * self.fanout, run * self.fanout + self.fanout - 1)).alias("idx")).distinct()
        return wanted.join(self.nodes.drop("n"), ["tree", "level", "idx"])


def trees(leaves: DataFrame, order: list, fanout: int = 3, per: int = 32_768) -> Trees:
    """The trees of leaves: tree (a string, never null), leaf (hex), and the columns of order."""
    own, stretches = indexed(leaves, order, per)
    nodes = merged(peaks(own, fanout), fanout)
    return Trees(own, stretches, nodes, nodes.where(F.col("level") == _depth(F.col("n"), fanout)).select("tree", "digest"), fanout)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def prove(of: Trees, schema: str, fold: Callable[[list], Callable], columns: tuple[str, ...] = (), upper: DataFrame | None = None) -> DataFrame:
    """The rows (of schema, with types of _ARROW) that fold(rows of upper)(index, leaf, values of columns, path) gives for each leaf.

    A path is, from the leaf's run up to the tree's root, the digests left and right of the way, each side as one text.
    upper: tree, level, idx, digest: what a tree's leaves are folded with beyond its root, a few rows a tree.
    """
    kinds = dict(of.leaves.dtypes)
    others = [F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("leaf"), *(F.lit(None).cast(kinds[c]).alias(c) for c in columns)]
    rows = of.leaves.select("part", "tree", F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", F.lit(None).cast("string").alias("digest"), "n", "leaf", *columns)
    rows = rows.unionByName(of.outside().select("part", "tree", F.lit(1).alias("kind"), "level", "idx", "digest", *others))
    if upper is not None:
        rows = rows.unionByName(of.stretches.join(upper, "tree").select("part", "tree", F.lit(0).alias("kind"), "level", "idx", "digest", *others))
    fanout = of.fanout
    out_schema = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def stretch(above: list, known: list, stack: Range | None, held: list) -> list[tuple]:
        if stack is None:
            return []
        nodes, depth, each, out = stack.done, len(stack.widths) - 1, fold(above), []
        for level, idx, d in known:
            nodes[level].setdefault(idx, d)
        paths: list[tuple[int, list]] = [(-1, [])] * depth

        def path(level: int, idx: int) -> list[tuple[str, str]]:
            if level == depth:
                return []
            if paths[level][0] != idx:
                first = idx - idx % fanout
                run = range(first, min(first + fanout, stack.widths[level]))
                sides = "".join(nodes[level][i] for i in run if i < idx), "".join(nodes[level][i] for i in run if i > idx)
                paths[level] = idx, [sides, *path(level + 1, idx // fanout)]
            return paths[level][1]

        for idx, d, values in held:
            out.extend(each(idx, d, values, path(0, idx)))
        return out

    def walk(batches):
        now, above, known, stack, held, out = None, [], [], None, [], []
        for batch in batches:
            for part, tree, kind, level, idx, d, n, own, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, tree) != now:
                    out += stretch(above, known, stack, held)
                    now, above, known, stack, held = (part, tree), [], [], None, []
                if kind == 0:
                    above.append((level, idx, d))
                elif kind == 1:
                    known.append((level, idx, d))
                else:
                    stack = stack or Range(n, fanout)
                    stack.push(idx, own)
                    held.append((idx, own, values))
            if len(out) > 10_000:
                yield _batch(out, out_schema)
                out = []
        yield _batch(out + stretch(above, known, stack, held), out_schema)

    return rows.repartition("part").sortWithinPartitions("part", "tree", "kind", "level", "idx").mapInArrow(walk, schema)


def _upper(above: list) -> Callable:
    """A source's way in the tree over the sources, as rows for its leaves: level -1 is its root; then the sides, idx 0 left and 1 right."""

    def rows(idx: int, node: str, values: list, path: list) -> list[tuple]:
        return [(values[0], -1, 0, node), *((values[0], level, side, text) for level, sides in enumerate(path) for side, text in enumerate(sides))]

    return rows


def verify(docs: DataFrame, changed: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "source", text_col: str = "text", fanout: int = 3, per: int = 32_768) -> DataFrame:
    """The manifest of docs, and what becomes of it where a row's text is found as changed.

    A row per row: columns[0], leaf, subroot, root, proof_sha256 (of the siblings from the leaf to the root), folded_root
    (the changed leaf with the siblings of the original) and verified.
    """
    key = columns[0]
    own = leaf([F.col(c) for c in columns])
    other = leaf([changed if c == text_col else F.col(c) for c in columns])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(tree_col).cast("string")), F.lit("0"))
    leaves = docs.select(tree.alias("tree"), F.col(key).cast("long").alias("id"), own.alias("leaf"), other.alias("found"))
    leaves = leaves.withColumn("found", F.when(F.col("found") != F.col("leaf"), F.col("found")))  # mostly the same: null
    low = trees(leaves, [F.col("id").asc_nulls_first(), "leaf"], fanout, per)
    high = trees(low.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf")), ["name"], fanout, per)
    top = high.roots.first()
    root = top["digest"] if top else ""

    def fold(above: list) -> Callable:
        subroot = next(d for level, _, d in above if level < 0)
        sides = {(level, side): d for level, side, d in above if level >= 0}
        beyond = [(sides[level, 0], sides[level, 1]) for level in range(len(sides) // 2)]
        rest = "".join(a + b for a, b in beyond)
        seen: dict[int, tuple] = {}

        def up(idx: int, node: str, path: list) -> str:
            """The root that node folds to; neighbours mostly share the rest of the way."""
            todo = []
            for level, (left, right) in enumerate(path + beyond):
                at = idx // fanout**level, node
                if seen.get(level, ((),))[0] == at:
                    node = seen[level][1]
                    break
                todo.append((level, at))
                node = digest([left, node, right])
            for level, at in todo:
                seen[level] = at, node
            return node

        def row(idx: int, node: str, values: list, path: list) -> list[tuple]:
            proof = hashlib.sha256(("".join(a + b for a, b in path) + rest).encode()).hexdigest()
            folded = up(idx, values[1] or node, path)
            return [(values[0], node, subroot, root, proof, folded, folded == root)]

        return row

    schema = f"{key} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    upper = cut(prove(high, "tree string, level int, idx long, digest string", _upper, ("name",)))
    return prove(low, schema, fold, ("id", "found"), upper)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verify(docs, F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text")))


def _sql_levels(name: str, start: str, keep: str, levels: int) -> str:
    """CTEs of the levels of trees: name0(k, i, n, x: index and digest of the node that row keep is in, p: siblings so far, f: what the changed leaf folds to)."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for level in range(levels):
        out.append(
            f"""{name}r{level} AS MATERIALIZED (SELECT k, i // 3 AS r, array_agg(x ORDER BY i) AS run FROM (SELECT DISTINCT k, i, x FROM {name}{level} WHERE n > 1) GROUP BY k, i // 3),
{name}{level + 1} AS MATERIALIZED (SELECT t.k, {keep}, t.i // 3 AS i, (t.n + 2) // 3 AS n, CASE WHEN t.n > 1 THEN sha256(array_to_string(run, '')) ELSE x END AS x,
  CASE WHEN t.n > 1 THEN p || array_to_string(run[1 : t.i % 3] || run[t.i % 3 + 2 :], '') ELSE p END AS p,
  CASE WHEN t.n > 1 THEN sha256(array_to_string(run[1 : t.i % 3], '') || f || array_to_string(run[t.i % 3 + 2 :], '')) ELSE f END AS f
  FROM {name}{level} t LEFT JOIN {name}r{level} r ON t.n > 1 AND t.k IS NOT DISTINCT FROM r.k AND t.i // 3 = r.r)"""
        )
    return ",\n".join(out)


def _sql_frame(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


_LEVELS = 14  # of sources, and of rows of a source: 3 ** 14
_LEAF = "sha256(" + " || ".join(_sql_frame(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS UBIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))), lambda a, b: CASE WHEN b < 256 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, source, {_LEAF.format(_sql_frame("text"))} AS leaf, {_LEAF.format(_sql_frame("t"))} AS other
  FROM (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents)),
{_sql_levels("a", "SELECT source AS k, doc_id, leaf, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS x, '' AS p, other AS f FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)", "doc_id, leaf", _LEVELS)},
s AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM d)),
{_sql_levels("b", f"SELECT 0 AS k, doc_id, leaf, t.x AS subroot, s.at AS i, s.n, t.x, t.p, t.f FROM a{_LEVELS} t JOIN s ON t.k IS NOT DISTINCT FROM s.source", "doc_id, leaf, subroot", _LEVELS)}
SELECT doc_id, leaf, subroot, x AS root, sha256(p) AS proof_sha256, f AS folded_root, f = x AS verified FROM b{_LEVELS}
"""
