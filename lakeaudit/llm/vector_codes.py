"""Product codes of vectors by filtering Lloyd: kd-trees over runs of vectors, and boxes that rule codebook entries out.

Each vector is cut into parts, each part position has a codebook, and Lloyd rounds move its entries. The vectors of a
partition are taken in runs of bounded length, and each run gets a kd-tree per part position, once: its points in the
order of the tree, and for each node its box, its points' sum and their number. The trees go to the checkpoint folder.
A round walks down every tree with the entries that may still be nearest somewhere in the box: the one nearest to the
middle of the box rules out every entry that is no nearer at the corner which suits that entry best. A node that one
entry is left for is assigned whole, by its stored sum and count; a leaf compares its points with the entries that
are left. A task returns sums and counts of entries, which Spark adds up; the codebooks are the one thing that the driver
and every task hold.

Components become floor(scale * x), x as double, and all that follows is whole numbers: as float64 where a run's numbers
keep every distance and sum exact, else as Python's unbounded ones. Sums travel as digits of DIGIT bits. Equal
distances go to the lower index, so a box rules out an entry at equality only for a lower index.

Vectors null or holding a null or non-finite component take no part. A shorter vector counts as 0 where it ends, so an
empty one is all 0; the greatest length, rounded up to a multiple of the number of parts, is the width. Null ids are codes
like others, and last where the first codebooks are chosen; rows of equal ids are chosen in order of their vectors. Fewer
vectors than entries make a smaller codebook. Null labels are one label. A sum of errors that a long can't hold is an
error. An empty table gives no rows. Copies are points like others: a box of no extent is assigned whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.spark import cut, few, give_back, table

#: Whole numbers up to this are exact as float64.
EXACT = 2**52
DIGIT = 31
RUN, LEAF = 4096, 64


class Tree:
    """A kd-tree over the rows of points (whole numbers). Node i: points begin[i] to end[i] in the tree's order; children i + 1 and right[i], none (0) for a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        nodes: list[list] = []
        stack = [(0, len(points), -1)]
        while stack:
            begin, end, parent = stack.pop()
            if parent >= 0:
                nodes[parent][2] = len(nodes)
            own = points[self.order[begin:end]]
            low, high = own.min(0), own.max(0)
            nodes.append([begin, end, 0, low, high, own.sum(0)])
            extent = high - low
            if end - begin > leaf and extent.max() > 0:
                axis, middle = int(np.argmax(extent)), (end - begin) // 2
                self.order[begin:end] = self.order[begin:end][np.argsort(own[:, axis], kind="stable")]
                here = len(nodes) - 1
                stack.append((begin + middle, end, here))
                stack.append((begin, begin + middle, -1))
        self.points = points[self.order]
        self.begin, self.end, self.right = (np.array([n[i] for n in nodes], np.int32) for i in range(3))
        self.low, self.high, self.sums = (np.array([n[i] for n in nodes], points.dtype).reshape(len(nodes), points.shape[1]) for i in range(3, 6))

    def unbounded(self) -> Tree:
        """The tree in Python's whole numbers."""
        for name in ("points", "low", "high", "sums"):
            a = getattr(self, name)
            setattr(self, name, np.array([int(v) for v in a.ravel().tolist()], object).reshape(a.shape))
        return self

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums and counts of the points nearest to each entry, and the nearest entry of each point in the tree's order."""
        entries = entries.astype(self.points.dtype)
        square = (entries * entries).sum(1)
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        found, single = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), bool)
        stack = [(0, np.arange(len(entries)))]
        while stack:
            node, left = stack.pop()
            low, high = self.low[node], self.high[node]
            if len(left) > 1:
                middle = low + high  # twice the middle
                best = left[np.argmin(square[left] - entries[left] @ middle)]
                # At the corner that is best for an entry: is it no nearer than the best one even there?
                way = entries[left] - entries[best]
                reach = np.maximum(way, 0) @ (2 * high) - np.maximum(-way, 0) @ (2 * low)
                gap = square[left] - square[best] - reach
                left = left[(gap < 0) | ((gap == 0) & (left <= best))]
            begin, end, right = self.begin[node], self.end[node], self.right[node]
            if len(left) == 1:
                sums[left[0]] += self.sums[node]
                counts[left[0]] += end - begin
                found[begin:end] = left[0]
            elif right:
                stack += [(right, left), (node + 1, left)]
            else:
                own = self.points[begin:end]
                nearest = left[np.argmin(square[left] - 2 * (own @ entries[left].T), axis=1)]
                found[begin:end], single[begin:end] = nearest, True
        # The points of leaves are added up together, in order of their entries.
        at = np.flatnonzero(single)
        at = at[np.argsort(found[at], kind="stable")]
        if len(at):
            first = np.flatnonzero(np.append(True, np.diff(found[at]) > 0))
            own = found[at[first]]
            sums[own] += np.add.reduceat(self.points[at], first, axis=0)
            counts += np.bincount(found[at], minlength=len(entries))
        return sums, counts, found

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry and its squared distance for each row of the points that the tree was built of."""
        found = self.assign(entries)[2]
        gone = self.points - entries.astype(self.points.dtype)[found]
        out = np.empty(len(found), np.int64), np.empty(len(found), object)
        out[0][self.order], out[1][self.order] = found, [int(v) for v in (gone * gone).sum(1).tolist()]
        return out


def whole(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """A row per vector of floor(scale * component): float64 where sums and distances of a run stay exact, else Python's whole numbers."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    most = float(np.abs(scaled).max(initial=0))
    kind = np.float64 if most < 2**26 and most**2 * 16 * max(1, width) * RUN < EXACT else object
    if kind is object:
        ratio = scale.as_integer_ratio()
        parts = [v.as_integer_ratio() for v in values.tolist()]
        scaled = np.array([a * ratio[0] // (b * ratio[1]) for a, b in parts], object)
    out = np.zeros((len(sizes), width), kind)
    if kind is object:
        out[:] = 0
    out[np.repeat(np.arange(len(sizes)), sizes), at] = scaled
    return out


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def forest(vectors: DataFrame, width: int, parts: int, scale: float, run: int = RUN) -> DataFrame:
    """vectors (id, label, v) as runs: ids and labels, and the pickled kd-trees of their parts."""
    size = width // parts

    def build(batches):
        try:
            for t in _runs(batches, run):
                points = whole(t.column("v").combine_chunks(), width, scale)
                trees = pickle.dumps([Tree(np.ascontiguousarray(points[:, p * size : (p + 1) * size])) for p in range(parts)], protocol=5)
                ids, labels = ([c.to_pylist()] for c in (t.column("id"), t.column("label")))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(t.schema.field("id").type)), pa.array(labels, pa.list_(t.schema.field("label").type)), pa.array([trees], pa.binary())], ["ids", "labels", "trees"])
        finally:
            give_back()

    kind = dict(vectors.dtypes)
    return vectors.select("id", "label", "v").mapInArrow(build, f"ids array<{kind['id']}>, labels array<{kind['label']}>, trees binary")


def _exact(trees: list[Tree], books: list[np.ndarray]) -> Iterator[tuple[Tree, np.ndarray]]:
    """Each part's tree and codebook, in Python's whole numbers where float64 wouldn't be exact."""
    for tree, entries in zip(trees, books, strict=True):
        most = max((abs(v) for v in entries.ravel().tolist()), default=0)
        fits = tree.points.dtype != object and most**2 * 16 * entries.shape[1] < EXACT
        yield tree if fits or tree.points.dtype == object else tree.unbounded(), entries


def lloyd_round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks (whole numbers of Python) after one round over all runs; an entry that no part is nearest to stays."""
    size = books[0].shape[1]

    def assign(batches):
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                for p, (tree, entries) in enumerate(_exact(pickle.loads(blob), books)):
                    sums, counts, _ = tree.assign(entries)
                    for e in np.flatnonzero(counts).tolist():
                        t = total.setdefault((p, e), [0, [0] * size])
                        t[0], t[1] = t[0] + int(counts[e]), [a + int(b) for a, b in zip(t[1], sums[e].tolist(), strict=True)]
        rows = []
        for (p, e), (n, sums) in total.items():
            for k in range(max(1, *(-(-abs(v).bit_length() // DIGIT) for v in sums))):
                rows.append((p, e, k, n if k == 0 else 0, [((abs(v) >> DIGIT * k) & ((1 << DIGIT) - 1)) * (1 if v >= 0 else -1) for v in sums]))
        names, kinds = ("part", "entry", "k", "n", "digits"), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    found = trees.select("trees").mapInArrow(assign, "part int, entry int, k int, n long, digits array<long>")
    rows = found.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), *(F.sum(F.col("digits")[i]).alias(f"d{i}") for i in range(size))).collect()
    out = [book.copy() for book in books]
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        at = r["part"], r["entry"]
        counts[at] = counts.get(at, 0) + r["n"]
        sums[at] = [v + (r[f"d{i}"] << DIGIT * r["k"]) for i, v in enumerate(sums.get(at, [0] * size))]
    for (p, e), n in counts.items():
        out[p][e] = [v // n for v in sums[p, e]]
    return out


def compress(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", run: int = RUN) -> tuple[DataFrame, list[np.ndarray]]:
    """id_col, label_col, code (an index of two or more hex digits for each part), error of every kept vector; and the codebooks."""
    kept = vectors.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    kept = kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    size = max(1, -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // parts))
    start = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    first = [[int(v) for v in row] for row in whole(pa.array(start, pa.list_(pa.float64())), size * parts, scale).tolist()]
    books = [np.array([row[p * size : (p + 1) * size] for row in first], object).reshape(len(first), size) for p in range(parts)]
    trees = cut(forest(kept, size * parts, parts, scale, run))
    for _ in range(rounds if len(first) else 0):
        books = lloyd_round(trees, books)
    digits = max(2, len(f"{entries - 1:x}"))
    kind = dict(kept.dtypes)

    def encode(batches):
        for batch in batches:
            for ids, labels, blob in zip(*(batch.column(c) for c in ("ids", "labels", "trees")), strict=True):
                each = [tree.codes(book) for tree, book in _exact(pickle.loads(blob.as_py()), books)]
                codes = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*(c.tolist() for c, _ in each), strict=True)]
                errors = [sum(row) for row in zip(*(d.tolist() for _, d in each), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes), pa.array(errors, pa.int64())], names=[id_col, label_col, "code", "error"])

    return trees.mapInArrow(encode, f"`{id_col}` {kind['id']}, `{label_col}` {kind['label']}, code string, error long"), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of the codebooks' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for row in book for v in row).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = cut(codes)
    sums = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    got = codes.join(few(sums, sums.count()), codes["label"].eqNullSafe(sums["label"]))
    return got.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_ROUND = """
a{k} AS MATERIALIZED (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.id, x.part, b.entry, x.q - 2 * list_dot_product(x.v, b.v) + b.q AS d FROM x JOIN b{k} b ON x.part = b.part) GROUP BY id, part),
m{k} AS MATERIALIZED (SELECT part, entry, list(floor(s / n) ORDER BY i) AS v FROM (
  SELECT a.part, a.entry, i, sum(x.v[i]) AS s, count(*) AS n FROM a{k} a JOIN x ON a.id = x.id AND a.part = x.part, range(1, len(x.v) + 1) r(i) GROUP BY a.part, a.entry, i) GROUP BY part, entry),
b{n} AS MATERIALIZED (SELECT part, entry, v, list_dot_product(v, v) AS q FROM (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry)),"""
OP11_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS q FROM (SELECT id, p AS part, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM k, range(4) r(p))),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, v, q FROM x WHERE id <= 256),{"".join(_ROUND.format(k=k, n=k + 1) for k in range(4))}
z AS MATERIALIZED (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM (
  SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.id, x.part, b.entry, x.q - 2 * list_dot_product(x.v, b.v) + b.q AS d FROM x JOIN b4 b ON x.part = b.part) GROUP BY id, part) GROUP BY id),
h AS (SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM b4, range(1, len(v) + 1) r(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN z USING (id), h
"""
