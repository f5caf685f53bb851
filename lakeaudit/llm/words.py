"""Words, lines and their hashes over the UTF-8 bytes of many texts at once (numpy; no loop over words).

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. A null text is an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BLOCK = 1 << 12
_LOW = _rng.integers(1, 2**64, _BLOCK, dtype=np.uint64, endpoint=False) | np.uint64(1)  # a weight of its own for each place


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 offsets between them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def segment_hash(data: np.ndarray, starts: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """A hash of the bytes from each start to the next one, without those that skip marks at their end.

    It is a multilinear hash: a random number for each byte value times a random weight for each place, summed modulo
    2 ** 64. Unlike powers of one base, such weights have no pattern that some pairs of strings cancel.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, table = [], _BYTE.copy()
    if skip is not None:
        table[skip] = 0
    cuts = np.searchsorted(starts, np.arange(0, len(data), 1 << 20))
    cuts = np.unique(np.append(cuts, len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
        own = starts[a:b] - lo
        at = np.arange(hi - lo) - np.repeat(own, np.diff(np.append(own, hi - lo)))
        weight = _LOW[at & (_BLOCK - 1)]
        if len(at) and at.max() >= _BLOCK:
            far = np.flatnonzero(at >= _BLOCK)
            weight[far] = mix(at[far].astype(np.uint64) * _LOW[0] + _LOW[1]) | np.uint64(1)
        values = table[data[lo:hi]] * weight
        out.append(np.add.reduceat(values, own))
    return mix(np.concatenate(out))


@dataclass
class Words:
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    doc: np.ndarray  #: index of its text
    first: np.ndarray  #: n + 1 offsets of each text's words


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def word_hash(data: np.ndarray, w: Words) -> np.ndarray:
    return segment_hash(data, w.starts, _SPACE)


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words; those at the end that lack words are left out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _LOW[k & (_BLOCK - 1)]
    return mix(out)


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of marked positions between each two offsets."""
    at = np.flatnonzero(marks)
    return np.diff(np.searchsorted(at, offsets))


def count_words(column: pa.Array) -> np.ndarray:
    data, offsets = flat(column)
    return np.diff(words(data, offsets).first)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


def again(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before, in their order."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def in_repeats(h: np.ndarray, w: Words, size: int = 8) -> np.ndarray:
    """Which words lie in a run of size words that its text holds twice or more."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(len(h), bool)
    whole = w.doc[:n] == w.doc[size - 1 :]
    at = np.flatnonzero(whole)
    keys = mix(window_hash(h, size)[at] + mix(w.doc[at].astype(np.uint64)))
    hit = at[repeated(keys)]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + size, -1)
    return np.cumsum(cover[:-1]) > 0


@dataclass
class Lines:
    starts: np.ndarray
    ends: np.ndarray  #: without the line feed
    doc: np.ndarray
    first: np.ndarray


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """The lines of each text that isn't empty, as split at line feeds."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    breaks = np.flatnonzero(data == 10)
    ends_text = np.zeros(n + 1, bool)
    ends_text[offsets] = True
    start[breaks[~ends_text[breaks + 1]] + 1] = True
    starts = np.flatnonzero(start[:n])
    ends = np.append(starts[1:], n)
    if n:
        ends = ends - (data[ends - 1] == 10)
    first = np.searchsorted(starts, offsets)
    return Lines(starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def line_hash(data: np.ndarray, own: Lines) -> np.ndarray:
    feed = np.zeros(256, bool)
    feed[10] = True
    return segment_hash(data, own.starts, feed)
