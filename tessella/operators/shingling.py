"""Sets of hashed shingles of whole texts, some of them at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that are cut at once, and of a token that is read in words of eight.
HELD, LONG = 1 << 20, 256

_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, one to one, as splitmix64 ends."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths of the tokens (runs of a-z and 0-9) of texts that start at ``at`` (and end with the last), and how
    many each text has. Tokens of up to eight bytes have different hashes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a text ends a token
    begin = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    size = np.flatnonzero(inside[:-1] & (edge | ~inside[1:])) - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mixed(words[begin] & _LOW[np.minimum(size, 8)])
    rest, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rest):
        h[rest] = mixed((h[rest] + np.uint64(k)) ^ (words[begin[rest] + k] & _LOW[np.minimum(size[rest] - k, 8)]))
        k += 8
        rest = rest[size[rest] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + size[i]].tobytes())
    return h, size, np.diff(np.searchsorted(begin, at))


def cut(h: np.ndarray, many: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of n tokens of each text, sorted, and how many each has; a text of fewer tokens has one of all.
    h: hashes of all tokens; many: how many each text has."""
    ends = np.cumsum(many)
    starts = ends - many
    of = np.repeat(np.arange(len(many)), np.maximum(many - n + 1, np.minimum(many, 1)))
    size = np.bincount(of, minlength=len(many))
    first = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + starts[of]
    length = np.minimum(many[of], n)
    s = np.zeros(len(of), np.uint64)
    for k in range(n):
        if (length > k).all():
            s = mixed(s + np.uint64(1)) ^ h[first + k]
        else:  # short texts have fewer
            on = np.flatnonzero(length > k)
            s[on] = mixed(s[on] + np.uint64(1)) ^ h[first[on] + k]
    s = mixed(s + length.astype(np.uint64)).view(np.int64)
    at = 0
    for k in size.tolist():
        s[at : at + k].sort()
        at += k
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[new], np.bincount(of[new], minlength=len(many))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of batches (id, text): ids, bytes and starts of some texts at a time."""
    for batch in batches:
        c = batch.column(1)
        offsets = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_string(c.type) else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        data = np.frombuffer(c.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(c):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + HELD, "right")) - 1)
            yield batch.column(0).slice(row, to - row), data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
            row = to


def _lists(items: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(items))


def _lowered(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def shingled(texts: DataFrame, n: int) -> DataFrame:
    """(id, text) to (id, items array<bigint>): the distinct hashes of windows of n lower-case tokens, sorted, where tokens are
    those of ``text.tokens``. A text of 1 to n - 1 tokens is one window, one without tokens has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, at in _parts(batches):
            h, _, many = _tokens(data, at)
            yield pa.RecordBatch.from_arrays([ids, _lists(*cut(h, many, n))], ["id", "items"])

    return _lowered(texts).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, items array<bigint>")


def winnowed(words: list[bytes], n: int, window: int) -> np.ndarray:
    """The first 64 bits of the MD5 of the windows of n tokens that winnowing picks: the least of every ``window`` of them, of
    equal ones the leftmost; all if they are fewer."""
    grams = [b" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1 if words else 0))]
    h = np.frombuffer(b"".join([hashlib.md5(x).digest()[:8] for x in grams]), ">u8").astype(np.uint64)
    if len(h) >= window:
        every = np.lib.stride_tricks.sliding_window_view(h, window)
        h = h[np.unique(np.arange(len(every)) + every.argmin(axis=1))]
    return h.view(np.int64)


def measured(texts: DataFrame, n: int, window: int) -> DataFrame:
    """(id, text) to (id, t, g, f, l): hashes of all tokens, of the distinct pairs of them, of the winnowed windows of n, and the
    mean length of the tokens (null without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, at in _parts(batches):
            h, length, many = _tokens(data, at)
            total = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(many))]
            mean = pa.array([int(s) / int(k) if k else None for s, k in zip(np.diff(total), many, strict=True)], pa.float64())
            raw = data.tobytes()
            prints = [winnowed(re.findall(rb"[a-z0-9]+", raw[a:b]), n, window) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            f = _lists(np.concatenate(prints), np.array([len(x) for x in prints]))
            yield pa.RecordBatch.from_arrays([ids, _lists(h.view(np.int64), many), _lists(*cut(h, many, 2)), f, mean], ["id", "t", "g", "f", "l"])

    kind = texts.schema["id"].dataType.simpleString()
    return _lowered(texts).mapInArrow(run, f"id {kind}, t array<bigint>, g array<bigint>, f array<bigint>, l double")
