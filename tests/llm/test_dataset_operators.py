"""Vector codes, the Merkle manifest and shards, against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeaudit.llm import merkle_manifest, sharding, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Vector codes


def lloyd(rows, entries, parts, rounds, scale=1024):
    """(id, code as a list, error) of each kept row, and the codebooks, in Python's numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max(1, -(-max((len(v) for _, v in kept), default=0) // parts))
    points = [(i, [math.floor(Fraction(x) * scale) for x in v] + [0] * (size * parts - len(v))) for i, v in kept]
    start = sorted(range(len(points)), key=lambda k: (points[k][0] is None, points[k][0] or 0, kept[k][1]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(points[k][1], p) for k in start] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds if points else 0):
        for p in range(parts):
            got = defaultdict(list)
            for _, v in points:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, own in got.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, v in points:
        each = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each)))
    return out, books


VECTORS = {
    "random": lambda r: [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)],
    "ties and copies": lambda r: [(r.randrange(200), [r.choice([-0.5, 0.0, 0.25]) for _ in range(8)]) for _ in range(300)],
    "one group": lambda r: [(i, [0.5] * 8) for i in range(200)] + [(200 + i, [r.random() for _ in range(8)]) for i in range(60)],
    "few": lambda r: [(i, [r.random() for _ in range(8)]) for i in range(3)],
    "ragged": lambda r: [(None if i % 7 == 0 else i, [r.gauss(0, 1) for _ in range(r.choice([0, 3, 7, 10]))]) for i in range(80)],
    "bad": lambda r: [(0, None), (1, [1.0, None, 2.0, 3.0]), (2, [math.nan, 1.0, 1.0, 1.0]), (3, [math.inf] * 4), (4, [1.0, 2.0, 3.0, 4.0]), (5, [-1.0, 0.5, 0.0, -0.0])],
    "huge": lambda r: [(i, [r.choice([0.0, 1e30, 1e30 + 2e15, -3e200])] + [0.001 * r.randrange(9) for _ in range(3)]) for i in range(4)] * 3 + [(9, [0.5, 1.0, 2.0, 3.0])] * 2,
}


@pytest.mark.parametrize("kind", list(VECTORS))
def test_vector_codes(spark, kind):
    rows = VECTORS[kind](random.Random(5))
    entries = 16 if len(rows) > 20 else 4
    df = spark.createDataFrame([(i, v, None if k % 3 == 0 else k % 2, "x") for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, label int, code string")
    want, books = lloyd(rows, entries, 4, 4)
    got, own = vector_codes.compress(df.repartition(3), entries=entries, run=64)
    as_text = lambda x: sorted(map(str, x))
    assert as_text((r.vec_id, r.code, r.error) for r in got.collect()) == as_text(want)
    assert [book.tolist() for book in own] == books


def test_vector_codes_of_none_and_trees(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(none)[0].count() == vector_codes.compress(none.limit(0))[0].count() == 0
    r = np.random.default_rng(1)
    points = np.floor(r.normal(0, 40, (500, 5)))
    points[100:300] = points[0]
    entries = np.unique(np.floor(r.normal(0, 40, (40, 5))), axis=0)
    tree = vector_codes.Tree(points)
    sums, counts, _ = tree.assign(entries)
    d = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert tree.codes(entries)[0].tolist() == d.argmin(1).tolist() and tree.codes(entries)[1].tolist() == d.min(1).tolist()
    assert counts.tolist() == np.bincount(d.argmin(1), minlength=len(entries)).tolist() and sums.sum() == points.sum()
    assert max(tree.end[i] - tree.begin[i] for i in range(len(tree.right)) if not tree.right[i] and (tree.low[i] != tree.high[i]).any()) <= vector_codes.LEAF
    digits = vector_codes.digest([np.array([[1, -2]], object), np.array([[3, 40]], object)])
    assert digits == hashlib.sha256(b"1,-2,3,40").hexdigest()


# Merkle manifest


def merkle(rows, fanout):
    """Of rows (doc_id, text, lang, source, n_chars): doc_id, leaf, subroot, root, proof, folded root."""
    H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: H([frame(v) for v in (d, s, lang, n, t)])
    bad = lambda d, t: t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t

    def tree(leaves):
        """root, and each leaf's path of (own place in the run, the others)."""
        level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
        while len(level) > 1:
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            for k, i in enumerate(at):
                run, own = runs[i // fanout], i % fanout
                paths[k].append((own, run[:own] + run[own + 1 :]))
                at[k] = i // fanout
            level = [H(run) for run in runs]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], bad(r[0], r[1]), *r[2:]), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: (own := sorted(groups[s], key=lambda x: x[:3]), *tree([x[2] for x in own])) for s in names}
    root, high = tree([low[s][1] for s in names]) if names else ("", [])
    out = []
    for k, s in enumerate(names):
        own, subroot, paths = low[s]
        for (_, _, node, other, doc), path in zip(own, paths, strict=True):
            folded = other
            for at, rest in path + high[k]:
                folded = H([*rest[:at], folded, *rest[at:]])
            out.append((doc, node, subroot, root, H([d for _, rest in path + high[k] for d in rest]), folded, folded == root))
    return out


def documents(r, n, sources):
    text = lambda: r.choice([None, "", "a\nb", "x" * r.randrange(50), "zwei\n\nZeilen ä", "plain"])
    return [(r.choice([None, i, i, i, i // 5]), text(), r.choice([None, "en"]), sources(i), r.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize(
    "n, sources, fanout, per",
    [(0, None, 3, 10), (1, lambda i: None, 3, 10), (2, lambda i: "a", 3, 1), (500, lambda i: "hot", 3, 7), (500, lambda i: None if i % 3 else f"s{i % 11}", 3, 40), (300, lambda i: f"ü{i}", 3, 16), (700, lambda i: "a" if i % 2 else chr(0xFFFF) if i % 3 else "\U00010000", 2, 9), (400, lambda i: f"{i % 2}", 5, 3)],
)
def test_manifest(spark, n, sources, fanout, per):
    rows = documents(random.Random(n), n, sources)
    rows += rows[: n // 10]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("leaf", "tree", "part", "idx")})
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle_manifest.verify(df, changed, fanout=fanout, per=per).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, merkle(rows, fanout)))


def test_manifest_nodes(spark):
    """Every node, whatever stretch or merge made it, is the digest of its children."""
    leaves = spark.range(1000).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    of = merkle_manifest.trees(leaves, ["id"], 3, 17)
    nodes = {(r.tree, r.level, r.idx): r.digest for r in of.every_node().collect()} | {(r.tree, 0, r.idx): r.leaf for r in of.leaves.collect()}
    for tree, n in (("a", 900), ("b", 100)):
        level, width = 0, n
        while width > 1:
            for i in range(-(-width // 3)):
                assert nodes[tree, level + 1, i] == merkle_manifest.digest([nodes[tree, level, k] for k in range(3 * i, min(3 * i + 3, width))])
            level, width = level + 1, -(-width // 3)
        assert sum(k[0] == tree for k in nodes) == sum(1 for k in nodes if k[0] == tree and k[1] <= level)
    assert of.roots.count() == 2


# Shards


def deal(spark, rows, shards, per=100_000):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("size", "shard", "id", "key_0", "node")})
    got = sharding.shard(df.repartition(5), shards, per=per).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)
    return [size[s] for s in range(shards)], got


@pytest.mark.parametrize("kind", ["mixed", "one source", "copies", "same rows", "nulls"])
def test_shards_are_near_equal(spark, kind):
    r = random.Random(2)
    row = {
        "mixed": lambda i: (i, "x" * r.randrange(200), f"l{i % 4}", f"s{i % 9}" if i % 3 else "hot", i),
        "one source": lambda i: (i, "x" * r.randrange(200), "en", "hot", i),
        "copies": lambda i: (i, "copy" if i % 3 else "x" * r.randrange(200), "en", "s", i),
        "same rows": lambda i: (7, "copy", "en", "s", 4),
        "nulls": lambda i: (None if i % 2 else i, None, None, None, None),
    }[kind]
    rows = [row(i) for i in range(4000)]
    sizes, _ = deal(spark, rows, 7, per=500)
    target, most = sum(sizes) / 7, 220 if kind != "same rows" else 500
    assert all(abs(s - target) <= most for s in sizes)


def test_shards_of_odd_tables(spark):
    assert deal(spark, [], 5)[0] == [0] * 5
    assert sorted(deal(spark, [(1, "a", None, "s", 1)], 5)[0]) == [0, 0, 0, 0, 17]
    sizes, got = deal(spark, [(i, "long " * 5000 if i == 3 else "b" * i, "en", f"s{i}", 1) for i in range(300)], 4)
    assert max(sizes) < 25_100 and all(sizes)
    # Documents of a source lie together as far as shards allow: few shards share one.
    of = defaultdict(set)
    for r in deal(spark, [(i, "c" * 40, "en", f"s{i % 20}", 1) for i in range(2000)], 10)[1]:
        of[r.doc_id % 20].add(r.shard)
    assert sum(len(s) for s in of.values()) <= 20 + 9
    assert deal(spark, [(i, "a", "b", "c", 1) for i in range(10)], 1)[0] == [170]


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i, "x" * (i * 7 % 150), f"l{i % 3}", f"s{i % 5}", i) for i in range(1500)]
    ways = [{(r.doc_id, r.shard, r.slot) for r in sharding.shard(spark.createDataFrame(rows, DOCS).repartition(n), 8, per=200).collect()} for n in (2, 9)]
    assert ways[0] == ways[1]
