"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics.

Each language has a tree of byte contexts of order 0 to 3. A byte's probability in a context that was seen n times,
with d different next bytes, is count / (n + d) if it followed there; else the context escapes with d / (n + d) to its
suffix, whose distribution is scaled to the bytes not yet excluded. Below order 0 all unseen bytes are alike. A text's
code length under a language is the sum of -log2 of its bytes' probabilities: statistics are frozen, so a byte's cost
depends on the three bytes before it alone, and the costs of every context kept are computed once, exactly. The least
code length names the language; the score is its share when 2 ** -length is made to add up to one over the languages.

Training reads a bounded sample of labelled rows (docs_per_lang of each language, chosen by a hash of the id) and counts
byte runs in Spark. What reaches the driver is the counts of the sample's distinct runs of four bytes; every one counts,
and every context is kept. A language holds only what it saw, as sorted arrays of (context, byte) with their bits and of
contexts with the bits of their escape, so the model grows with the runs of each language, not with contexts times
bytes times languages. A text's distinct runs are searched there, order by order, until one is found; the runs that the
sample saw most often are kept resolved for all languages (CACHE_BYTES), which changes no length.

A null text, or one without a letter, is ``und`` with score 0. Null labels teach nothing; a null id counts as the
empty text where its remainder is taken. Repeated rows are predicted each on their own. Without any labelled row every
document is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import words as W
from lakeaudit.llm.spark import by_slice, table

ORDER = 3
CACHE_BYTES = 1 << 25  #: of the costs that are kept resolved for all languages
_SLOTS = 20  #: bits of a place in the cache
_FLOOR = -np.log2(1e-30)  #: most bits of a byte
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PIECE = 1 << 20  #: bytes that are scored at once


@dataclass
class Language:
    """By order: seen (context, byte) runs as sorted numbers and their bits; contexts and the bits of their escape."""

    runs: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]


@dataclass
class Model:
    langs: list[str]
    parts: list[Language]
    cached: np.ndarray  #: place -> the run that is resolved there
    row: np.ndarray  #: place -> row of cost
    cost: np.ndarray  #: bits under each language, float32


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with three spaces before each, and the offsets of their first bytes."""
    n = len(offsets) - 1
    starts = offsets[:-1] + ORDER * np.arange(1, n + 1)
    out = np.full(len(data) + ORDER * n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(offsets))] = data
    return out, starts


def byte_runs(labelled: DataFrame, lang_col: str, text_col: str) -> pd.DataFrame:
    """lang, run (four bytes as a number), n: every run of the texts."""

    def count(batches):
        for batch in batches:
            for part in by_slice(lambda x: x, text_col)([batch]):
                langs = part.column(0).dictionary_encode()
                data, offsets = W.flat(pc.utf8_lower(part.column(1)))
                spaced, starts = _spaced(data, offsets)
                run = spaced.astype(np.uint32)
                run[ORDER:] |= (run[2:-1] & 255) << 8 | (run[1:-2] & 255) << 16 | (run[:-3] & 255) << 24
                sizes = np.diff(offsets)
                at = np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)
                key = run[at].astype(np.int64) | np.repeat(langs.indices.to_numpy(), sizes).astype(np.int64) << 32
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["lang", "run", "n"])

    got = labelled.select(lang_col, text_col).mapInArrow(count, "lang string, run long, n long")
    return got.groupBy("lang", "run").agg(F.sum("n").alias("n")).toPandas()


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is in sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def learn(run: np.ndarray, n: np.ndarray) -> Language:
    """The tree of a language from its runs of four bytes and their counts."""
    out, below = Language([], [], [], []), None
    for order in range(ORDER + 1):
        keys, inverse = np.unique(run & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        count = np.bincount(inverse, n, len(keys))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
        chance = count / (total + kinds)[of]
        # What the shorter context gives to the bytes that followed here is left out of an escape.
        shorter = np.full(len(keys), 1 / 256) if below is None else below[1][_found(below[0], keys & ((1 << 8 * order) - 1))[0]]
        free = np.maximum(1 - np.bincount(of, shorter, len(contexts)), 1e-9)
        out.runs.append(keys.astype(np.uint32))
        out.bits.append((-np.log2(chance)).astype(np.float32))
        out.contexts.append(contexts.astype(np.uint32))
        out.escape.append((-np.log2(kinds / (total + kinds) / free)).astype(np.float32))
        below = keys, chance
    return out


def resolve(parts: list[Language], runs: np.ndarray) -> np.ndarray:
    """Bits of each run's last byte after its first three, under each language."""
    out = np.empty((len(runs), len(parts)), np.float32)
    for k, own in enumerate(parts):
        bits, todo = np.zeros(len(runs)), np.arange(len(runs))
        for order in range(ORDER, -1, -1):
            if not len(todo):
                break
            key = runs[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, there = _found(own.runs[order], key)
            bits[todo[there]] += own.bits[order][at[there]]
            todo, key = todo[~there], key[~there]
            at, there = _found(own.contexts[order], key >> np.uint32(8))
            bits[todo[there]] += own.escape[order][at[there]]
        bits[todo] += 8  # below order 0 all bytes are alike
        out[:, k] = np.minimum(bits, _FLOOR)
    return out


def _place(runs: np.ndarray) -> np.ndarray:
    return ((runs.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)).astype(np.int64)


def build(runs: pd.DataFrame) -> Model:
    """The trees of all languages, and the runs that are looked up most, resolved."""
    parts = {str(lang): learn(x["run"].to_numpy(np.int64), x["n"].to_numpy(np.float64)) for lang, x in sorted(runs.groupby("lang"))}
    common = runs.groupby("run")["n"].sum().sort_values(ascending=False, kind="stable").index.to_numpy(np.uint32)
    _, first = np.unique(_place(common), return_index=True)  # of runs that share a place, the commonest
    first = np.sort(first)[: CACHE_BYTES // (4 * max(1, len(parts)))]
    common = common[first]
    place = _place(common)
    cached, row = np.full(1 << _SLOTS, common[0]), np.zeros(1 << _SLOTS, np.int32)  # an empty place holds a run that belongs elsewhere
    cached[place], row[place] = common, np.arange(len(common))
    return Model(list(parts), list(parts.values()), cached, row, resolve(list(parts.values()), common))


def costs(model: Model, runs: np.ndarray) -> np.ndarray:
    """Bits of each run under each language."""
    place = _place(runs)
    out = model.cost[model.row[place]]
    other = np.flatnonzero(model.cached[place] != runs)
    if len(other):
        rare, inverse = np.unique(runs[other], return_inverse=True)
        out[other] = resolve(model.parts, rare)[inverse]
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    n = len(offsets) - 1
    out = np.zeros((n, len(model.langs)))
    spaced, starts = _spaced(data, offsets)
    ends = starts + np.diff(offsets)
    piece = max(1 << 12, _PIECE // max(1, len(model.langs) // 8))
    for lo in range(0, len(spaced), piece):
        hi = min(len(spaced), lo + piece)
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi)
        if first >= last:
            continue
        s = spaced[max(0, lo - ORDER) : hi].astype(np.uint32)
        runs = s[:-3] << np.uint32(24) | s[1:-2] << np.uint32(16) | s[2:-1] << np.uint32(8) | s[3:]
        shift = max(0, lo - ORDER) + ORDER
        begin, end = np.maximum(starts[first:last], lo) - shift, np.minimum(ends[first:last], hi) - shift
        keep = end > begin
        bounds = np.ravel(np.column_stack([begin[keep], end[keep]]))
        if not len(bounds):
            continue
        bits = np.vstack([costs(model, runs), np.zeros((1, len(model.langs)), np.float32)])
        out[np.arange(first, last)[keep]] += np.add.reduceat(bits, bounds, axis=0, dtype=np.float64)[::2]
    return out


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int) -> Model | None:
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = {r[lang_col]: r["n"] for r in labelled.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    most = F.create_map(*(F.lit(x) for k, n in per.items() for x in (k, min(1 << 30, docs_per_lang * (1 << 30) // n))))
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < most[F.col(lang_col)])
    runs = byte_runs(chosen, lang_col, text_col)
    return build(runs) if len(runs) else None


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, lang_pred and score; one pass over the texts."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.select(*keep).dtypes)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, batch.column(len(keep))
        data, offsets = W.flat(pc.utf8_lower(texts))
        bits = code_lengths(model, data, offsets)
        best = bits.argmin(1)
        share = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
        letters = W.per_text(_LETTER[data], offsets) > 0
        for i in np.flatnonzero(~letters):
            letters[i] = any(map(str.isalpha, texts[i].as_py() or ""))
        names = pa.array(model.langs, pa.string()).take(pa.array(best))
        names = pc.if_else(pa.array(letters), names, "und")
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), names, pa.array(np.where(letters, share, 0.0))], [*keep, "lang_pred", "score"])

    return docs.select(*keep, text_col).mapInArrow(by_slice(judge, text_col), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, docs_per_lang: int = 1500) -> DataFrame:
    """Train on the rows whose crc32 remainder isn't 0 and predict every row: id, held_out, lang_pred, score."""
    own = docs.select(id_col, text_col, lang_col).withColumn("held_out", remainder(id_col, folds) == 0)
    model = train(own.where(~F.col("held_out")), id_col, text_col, lang_col, docs_per_lang)
    return predict(own, model, [id_col, "held_out"], text_col)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
