"""Line-first quality rules: judge each line, remove those that fail, reject documents that lose too much text.

A line fails as
- repeat: it has a word and equals an earlier line of its document;
- markup: more than max_symbols of its characters are one of ``#*$%&|<>``;
- shouting: at least 4 words, most of whose letters are capitals, or most of whose ends are exclamation marks;
- navigation: 3 or more vertical bars, or no final punctuation on a line of at most 3 words that
  stands beside another such line;
- boilerplate: it holds a stock phrase and has at most 40 words.
A document is kept if the base rules pass and the lines that stay hold at least min_left of its words.

Final punctuation counts in any script, stock phrases in English, French, German and Spanish. A null text is an empty one:
no words, so base_failed. Repeated rows are judged each on their own. Columns besides
id and text are not read.
An empty table gives no rows; a very long text is judged whole, as a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeaudit.llm import words as W
from lakeaudit.llm.spark import by_slice, table

SYMBOLS = b"#*$%&|<>"
FINAL = ".!?:;\"')]}…。！？：；”’»›」』）．｡"
#: Letters of A-Z in either case; other letters as they stand here.
PHRASES = (
    "all rights reserved", "cookie policy", "we use cookies", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter", "subscribe to our", "skip to content",
    "tous droits réservés", "politique de confidentialité", "politique de cookies", "conditions générales", "cliquez ici", "mentions légales", "alle rechte vorbehalten", "wir verwenden cookies", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "zum inhalt springen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "haga clic aquí", "aviso legal",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _code(raw: bytes) -> int:
    """The last character's bytes as one number."""
    return int.from_bytes(raw, "big")


_SYMBOL, _BAR = _table(SYMBOLS), _table(b"|")
_FINAL = np.array(sorted(_code(c.encode()) for c in FINAL))
_CAPITAL, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))


def failed_lines(data: np.ndarray, w: W.Words, own: W.Lines, line_of_word: np.ndarray, dup: np.ndarray, max_symbols: float) -> np.ndarray:
    n = len(own.starts)
    bounds = np.append(own.starts, len(data))
    count = lambda marks: W.per_text(marks, bounds)
    words_in = np.bincount(line_of_word, minlength=n)
    chars = np.maximum(count((data & 0xC0) != 0x80), 1)
    markup = count(_SYMBOL[data]) > max_symbols * chars
    letters = count(_LETTER[data])
    bang = np.bincount(line_of_word, weights=data[w.ends - 1] == 33, minlength=n) if len(w.ends) else np.zeros(n)
    shouting = (words_in >= 4) & ((2 * count(_CAPITAL[data]) > letters) | (2 * bang > words_in))
    # The last character of each line's last word: its last byte, and the bytes before it that belong to it.
    end = np.ones(n, np.int64)
    end[line_of_word] = w.ends
    byte = lambda k: np.where(end > k, data[np.maximum(end - 1 - k, 0)], 0).astype(np.int64) if len(data) else np.zeros(n, np.int64)
    last, two, three = byte(0), byte(1), byte(2)
    code = np.where(last < 128, last, np.where(two >= 0xC0, two << 8 | last, three << 16 | two << 8 | last))
    short = (words_in > 0) & (words_in <= 3) & ~np.isin(code, _FINAL)
    beside = np.zeros(n, bool)
    pair = short[1:] & short[:-1] & (own.doc[1:] == own.doc[:-1])
    beside[1:] |= pair
    beside[:-1] |= pair
    navigation = (count(_BAR[data]) >= 3) | beside
    stock = np.zeros(n, bool)
    small = W.lower(data).tobytes()
    for phrase in map(str.encode, PHRASES):
        at = small.find(phrase)
        while at >= 0:
            line = int(np.searchsorted(own.starts, at, "right")) - 1
            stock[line] |= at + len(phrase) <= bounds[line + 1]
            at = small.find(phrase, at + len(phrase))
    return dup | markup | shouting | navigation | (stock & (words_in <= 40))


def measure(texts: pa.Array, min_left: float, max_symbols: float) -> dict[str, np.ndarray]:
    data, offsets = W.flat(texts)
    w, own = W.words(data, offsets), W.lines(data, offsets)
    n_words = np.diff(w.first)
    char = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[w.starts] += 1
    np.subtract.at(in_word, w.ends, 1)
    inside = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    line_of_word = np.searchsorted(own.starts, w.starts, "right") - 1
    has_word = np.bincount(line_of_word, minlength=len(own.starts)) > 0
    keyed = W.mix(W.line_hash(data, own) + W.mix(own.doc.astype(np.uint64)))
    dup = np.zeros(len(own.starts), bool)
    at = np.flatnonzero(has_word)
    dup[at] = W.again(keyed[at])
    repeats = np.bincount(w.doc, weights=W.in_repeats(W.word_hash(data, w), w), minlength=len(n_words)).astype(np.int64)
    failed = failed_lines(data, w, own, line_of_word, dup, max_symbols)
    left = np.bincount(w.doc, weights=~failed[line_of_word], minlength=len(n_words))
    base_failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": W.per_text(char & inside, offsets).astype(np.int64),
        "n_symbols": W.per_text(_SYMBOL[data], offsets).astype(np.int64),
        "n_dup_lines": np.bincount(own.doc, weights=dup, minlength=len(n_words)).astype(np.int64),
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": ~base_failed & (left >= min_left * n_words),
        "n_words_left": left.astype(np.int64),
        "n_failed_lines": np.bincount(own.doc, weights=failed, minlength=len(n_words)).astype(np.int64),
    }


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_left: float = 0.5, max_symbols: float = 0.1) -> DataFrame:
    """One row per document: its id, the base counts and the verdict. No shuffle; memory is bounded by a slice of texts."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = measure(batch.column(1), min_left, max_symbols)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols.values())], [id_col, *cols])

    kind = dict(docs.dtypes)[id_col]
    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_words_left long, n_failed_lines long"
    return docs.select(id_col, text_col).mapInArrow(by_slice(judge, text_col), f"`{id_col}` {kind}, {names}")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


_WORDS = r"[^\x20\x09-\x0D]+"
_STOCK = " OR ".join(f"contains(low, '{p}')" for p in PHRASES)
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, ws, len(ws) AS n_words FROM (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ws FROM d)),
runs AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS i, ws FROM w WHERE n_words >= 8),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM runs),
hit AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM hit, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM d WHERE text <> ''),
l1 AS (SELECT doc_id, line, k, regexp_extract_all(line, '{_WORDS}') AS ws, length(line) + CASE WHEN k < n THEN 1 ELSE 0 END AS chars, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  len(ws) AS nw, len(regexp_extract_all(line, '[A-Za-z]')) AS letters, len(regexp_extract_all(line, '[A-Z]')) AS capitals, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[|]')) AS bars FROM l0),
l2 AS (SELECT *, nw BETWEEN 1 AND 3 AND NOT contains('{FINAL.replace("'", "''")}', right(ws[nw], 1)) AS short, nw > 0 AND row_number() OVER (PARTITION BY doc_id, line, nw > 0 ORDER BY k) > 1 AS dup FROM l1),
l3 AS (SELECT *, short AND (coalesce(lag(short) OVER (PARTITION BY doc_id ORDER BY k), FALSE) OR coalesce(lead(short) OVER (PARTITION BY doc_id ORDER BY k), FALSE)) AS beside FROM l2),
l4 AS (SELECT doc_id, nw, dup, dup OR symbols > 0.1 * greatest(chars, 1) OR (nw >= 4 AND (2 * capitals > letters OR 2 * len(list_filter(ws, lambda x: ends_with(x, '!'))) > nw)) OR bars >= 3 OR beside OR (nw <= 40 AND ({_STOCK})) AS failed FROM l3 WHERE nw > 0 OR line <> '' OR chars > 0),
lines AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, sum(nw) FILTER (NOT failed) AS n_left, count(*) FILTER (failed) AS n_failed FROM l4 GROUP BY doc_id),
x AS (SELECT doc_id, n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_left, 0) AS n_words_left, coalesce(n_failed, 0) AS n_failed_lines FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_left >= 0.5 * n_words AS kept, n_words_left, n_failed_lines FROM x
"""
