"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics (lengths, shares of symbols, capitals, digits, repeats, lines and so
on). Each class has a mean and a covariance, shrunk toward the pooled covariance and then toward its diagonal. A
document's score is the logistic of the difference of the class log densities, each from the Mahalanobis distance by a
cached inverse Cholesky factor, plus the log ratio of the class frequencies.

One pass over the texts makes the vectors, which are written to the shared checkpoint folder: the fit and the scores read
them there. The fit is sums over all labelled rows outside the held-out fold, made in Spark; the driver gets a fixed
number of sums.

Null text: an empty text, all statistics 0. Null labels or ids teach nothing; several labels of a document count each.
A null id counts as the empty text where its remainder is taken. Repeated rows are scored each on their own. With labels
of one class alone, or none, every score is the share of label 1, or 0.5.
An empty table gives no rows; a very long text is measured whole, as a slice of its own. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import words as W
from lakeaudit.llm.language_id import remainder
from lakeaudit.llm.spark import by_slice, cut, table

FEATURES = ("words", "word_length", "symbols", "capitals", "digits", "bangs", "bars", "commas", "dup_lines", "repeats", "stutter", "distinct", "line_length", "sentence", "other")


def _table(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _CAPITAL, _DIGIT, _BANG, _BAR, _COMMA, _STOP = _table(b"#*$%&<>{}[]@\\^~_="), _table(range(65, 91)), _table(range(48, 58)), _table(b"!?"), _table(b"|"), _table(b",;:"), _table(b".")
_PLAIN = _table([*range(65, 91), *range(97, 123), *range(128, 256), 9, 10, 13, 32])  # letters, as far as bytes tell, and space


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = W.flat(texts)
    w, own = W.words(data, offsets), W.lines(data, offsets)
    n_words = np.diff(w.first)
    some, n = n_words + 10, len(n_words)  # the added words, characters and lines hold very short texts near the common values
    char = (data & 0xC0) != 0x80
    chars = W.per_text(char, offsets) + 50
    h = W.word_hash(data, w)
    share = lambda marks, by=chars: np.sqrt(W.per_text(marks, offsets) / by)
    by_word = lambda hit: np.bincount(w.doc, weights=hit, minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    fresh = ~W.again(W.mix(h + W.mix(w.doc.astype(np.uint64))))
    line_words = np.diff(np.append(np.searchsorted(w.starts, own.starts), len(w.starts)))
    at = np.flatnonzero(line_words > 0)
    n_lines = np.bincount(own.doc[at], minlength=n) + 1
    dup = W.again(W.mix(W.line_hash(data, own)[at] + W.mix(own.doc[at].astype(np.uint64))))
    return np.column_stack([
        np.log1p(n_words), np.log(chars / some), share(_SYMBOL[data]), share(_CAPITAL[data]), share(_DIGIT[data]),
        share(_BANG[data], some), share(_BAR[data], some), share(_COMMA[data], some), np.sqrt(np.bincount(own.doc[at], weights=dup, minlength=n) / n_lines),
        np.sqrt(by_word(W.in_repeats(h, w)) / some), np.sqrt(by_word(same) / some), np.log(by_word(fresh) + 10) / np.log(some),
        np.log1p(n_words / n_lines), np.sqrt((W.per_text(_STOP[data], offsets) + 1) / some), share(~_PLAIN[data] & ~_COMMA[data] & ~_STOP[data]),
    ])


def vectors(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep and x, the text's statistics."""
    kinds = dict(docs.select(*keep).dtypes)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(len(keep)))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), flat], [*keep, "x"])

    return docs.select(*keep, text_col).mapInArrow(by_slice(make, text_col), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "x array<double>"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    prior: float  #: log ratio of the frequencies of label 1 and label 0
    mean: list[np.ndarray]
    inverse: list[np.ndarray]  #: of each class's lower Cholesky factor
    log_root: list[float]  #: half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for sign, m, inv, root in zip((-1, 1), self.mean, self.inverse, self.log_root, strict=False):
            out += sign * (-root - 0.5 * (((x - m) @ inv.T) ** 2).sum(1))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(labelled: DataFrame, shrink: float, ridge: float) -> Model:
    """labelled: x and label (0 or 1)."""
    d = len(FEATURES)

    def sums(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], k)), pa.array(np.arange(total.shape[1])), pa.array(total[k])], ["label", "at", "v"])

    rows = labelled.select("x", F.col("label").cast("long").alias("label")).mapInArrow(sums, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    got = np.zeros((2, 1 + d + d * d))
    for r in rows:
        got[r["label"], r["at"]] = r["v"]
    n = got[:, 0]
    if n.min() < 2:
        share = n[1] / n.sum() if n.sum() else 0.5
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), [], [], [])
    mean = got[:, 1 : d + 1] / n[:, None]
    scatter = got[:, d + 1 :].reshape(2, d, d) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    inverse, log_root = [], []
    for k in (0, 1):
        cov = (1 - shrink) * scatter[k] / n[k] + shrink * pooled
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(d)
        low = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(low))
        log_root.append(float(np.log(np.diag(low)).sum()))
    return Model(float(np.log(n[1] / n[0])), list(mean), inverse, log_root)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, shrink: float = 0.1, ridge: float = 1e-3) -> DataFrame:
    """The columns to keep, held_out, score and predicted."""
    own = docs.withColumn("held_out", remainder(id_col, folds) == held)
    x = cut(vectors(own, list(dict.fromkeys([*keep, id_col, "held_out"])), text_col))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("labelled_id"), F.col(label_col).alias("label"))
    model = fit(x.where(~F.col("held_out")).join(known, F.col(id_col) == F.col("labelled_id")), shrink, ridge)
    kinds = dict(x.dtypes)
    out = list(dict.fromkeys([*keep, "held_out"]))

    def judge(batches):
        for batch in batches:
            p = model.score(_matrix(batch.column(len(out))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(out))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*out, "score", "predicted"])

    return x.select(*out, "x").mapInArrow(judge, ", ".join([*(f"`{c}` {kinds[c]}" for c in out), "score double, predicted int"]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, shrink: float = 0.1, ridge: float = 1e-3, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is least or more.

    Texts are read twice, once for the fit and once for the scores: neither texts nor statistics are shuffled or kept.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("labelled_id"), F.col(label_col).alias("label"))
    x = vectors(docs.where(remainder(id_col, folds) != held), [id_col], text_col)
    model = fit(x.join(known, F.col(id_col) == F.col("labelled_id")), shrink, ridge)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(features(batch.column(at))) >= least))

    return docs.mapInArrow(by_slice(run, text_col), docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
