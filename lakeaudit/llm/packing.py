"""Pack tokenised documents into sequences by first-fit decreasing in randomised groups.

One pass tokenises each text and cuts it into pieces: full sequences, and what is left. Pieces are dealt to groups by a
hash of their row, so a group is a bounded random sample of all lengths. Inside a group they are placed, longest first,
each into the first open sequence that has room; a tournament tree over the free room of the sequences finds it in
logarithmic time. What the last open sequences of a group lack is small beside a group of group_pieces.

Tokenising splits the bytes at white space and between a letter and a stop, which the tokenizer's own rules never
join, and encodes each distinct string once per Python worker. The store of encoded strings is emptied at a bound.

Null text: an empty document, whose one id is the end id. Repeated rows, and rows with equal or null ids, are packed each
on their own. Other columns are not read.
An empty table gives no rows. A very long text is encoded whole, string by string, and its ids are cut into as many
pieces as they need.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import words as W
from lakeaudit.llm.spark import cut, give_back, slices, table

END = 2
STORE_WORDS = 2_000_000  #: distinct strings that a worker keeps encoded
SLICE = 2 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Store:
    """The ids of strings by their hash: sorted hashes, and where each one's ids lie in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, text_of) -> np.ndarray:
        """The place of each of some sorted, distinct keys; text_of(i) gives the string of the i-th, where it is new."""
        if len(self.keys) + len(keys) > STORE_WORDS:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            size, ids = np.zeros(len(new), np.int32), array("I")
            for lo in range(0, len(new), 2048):  # an encoding is far larger than its ids
                for k, x in enumerate(self.tokenizer.encode_batch([text_of(i) for i in new[lo : lo + 2048]], add_special_tokens=False), lo):
                    size[k] = len(x.ids)
                    ids.extend(x.ids)
            at = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
            self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
            into = np.searchsorted(self.keys, keys[new])
            self.keys, self.at, self.size = (np.insert(a, into, b) for a, b in ((self.keys, keys[new]), (self.at, at), (self.size, size)))
            place = np.searchsorted(self.keys, keys)
        return place


_stores: dict[str, Store] = {}


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, each followed by the end id, and the n + 1 offsets between them."""
    store = _stores.get(path) or _stores.setdefault(path, Store(path))
    data, offsets = W.flat(texts)
    if not (data == 60).any():  # else a special token could come of capitals
        data = W.lower(data)
    w = W.words(data, offsets)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    stop = np.flatnonzero(_STOP[data] & ~edge[:-1])  # a text's first byte starts a word, whatever the text before ends in
    two = (data[np.maximum(stop - 2, 0)] == 0xC3) & (data[stop - 1] >= 0x80) & ((data[stop - 1] & 0x5F) != 0x17) & (stop > 1)
    stop = stop[_LETTER[data[stop - 1]] | two]
    starts = np.sort(np.concatenate([w.starts, stop]), kind="stable")  # a stop after a letter of its text never starts a word
    if not len(starts):
        n = len(offsets) - 1
        return np.full(n, END, np.uint32), np.arange(n + 1)
    ends = np.append(starts[1:], len(data))
    word = np.searchsorted(w.starts, starts, "right") - 1
    ends = np.minimum(ends, w.ends[word])
    keys, first, inverse = np.unique(W.segment_hash(data, starts, _SPACE), return_index=True, return_inverse=True)
    raw = data.tobytes()
    place = store.find(keys, lambda i: raw[starts[first[i]] : ends[first[i]]].decode())[inverse]
    size = store.size[place].astype(np.int64)
    doc = w.doc[word]
    # One id more at the end of each text.
    in_doc = np.bincount(doc, weights=size, minlength=len(offsets) - 1).astype(np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum(in_doc)])
    begin = np.cumsum(size) - size + doc
    out = np.full(bounds[-1], END, np.uint32)
    source = np.arange(int(size.sum())) + np.repeat(store.at[place] - (np.cumsum(size) - size), size)
    out[np.arange(len(source)) + np.repeat(begin - (np.cumsum(size) - size), size)] = store.ids[source]
    return out, bounds


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, length: int, with_ids: bool) -> DataFrame:
    """A row per piece: row (a number of its own), id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    id_type = docs.schema[id_col].dataType
    names = ["row", id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def cut_up(batches):
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                ids, bounds = token_ids(part.column(2), path)
                total = np.diff(bounds)
                n = -(-total // length)
                doc = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                a = bounds[doc] + start
                b = np.minimum(a + length, bounds[doc + 1])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
                row = part.column(0).take(pa.array(doc))
                cols = [row, part.column(1).take(pa.array(doc)), pa.array(start), pa.array(b - a), pa.array(crc), pa.array(total[doc])]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names)

    def run(batches):
        try:
            yield from cut_up(batches)
        finally:
            give_back()

    kinds = f"row long, `{id_col}` {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), id_col, text_col)
    return numbered.mapInArrow(run, kinds)


def first_fit_decreasing(size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there. The tree's root holds the largest free room of any bin."""
    bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    leaves = 1 << max(0, int(len(size) - 1).bit_length())
    tree = [room] * (2 * leaves)
    for i in np.argsort(-size, kind="stable").tolist():
        need, node = int(size[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offset[i] = node - leaves, room - tree[node]
        tree[node] -= need
        while node > 1:
            node >>= 1
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offset


def place(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """The places of a group's pieces, whatever order they come in: a task that is run again gives the same."""
    pdf = pdf.sort_values(["length", "row", "start"], ascending=[False, True, True])
    bins, offset = first_fit_decreasing(pdf["length"].to_numpy(), length)
    return pdf[["row", "start"]].assign(sequence_id=((pdf["group"].to_numpy() << 24) + bins) * 2, offset=offset)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = 4096, group_pieces: int = 16_384, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    cut_up = cut(pieces(docs, id_col, text_col, path or tokenizer_path(), length, with_ids))
    full = cut_up.where(F.col("length") == length)
    rest = cut_up.where(F.col("length") < length)
    n_groups = max(1, round(rest.count() / group_pieces))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("row", "start"), F.lit(n_groups)))
    out = [c for c in cut_up.columns if c != "row"]
    # Only lengths go through the groups, and ids of any type join back by row.
    placed = rest.select("row", "start", "length", "group").groupBy("group").applyInPandas(lambda pdf: place(pdf, length), "row long, start long, sequence_id long, offset long")
    joined = rest.drop("group").join(cut(placed), ["row", "start"])
    # Even numbers are for the groups' sequences, odd ones for pieces that fill one.
    own = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return joined.select(*out, "sequence_id", "offset").unionByName(own.select(*out, "sequence_id", "offset"))


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
