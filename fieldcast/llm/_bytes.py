"""Texts of an Arrow batch as one byte array, and hashes of their words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes handled at once; working arrays take about forty times as much
CHUNK = 1 << 20


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the start of each row (one
    more at the end). A null is empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, ends, data = col.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.empty(0, np.uint8)
    return raw, at - at[0]


def list_values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the start of each row."""
    at = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy()[at[0]:at[-1]], at - at[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices, in order, of about ``limit`` bytes of text; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(4)
def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BASE = 0x5851F42D4C957F2D


@lru_cache(2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U64(base), U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int, base: int = BASE) -> np.ndarray:
    size = max(CHUNK + 1, 1 << int(n).bit_length())
    return _powers(size, base)[:n]


@lru_cache(4)
def _tables(letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes, and which bytes belong to words."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    if letters_only:  # ASCII that is neither letter nor digit parts words too
        keep = {*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
        inside[[b for b in range(128) if b not in keep]] = False
    return lower, inside


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end of each word and, per row, the number of words before it.
    No word crosses from one row into the next."""
    n = len(raw)
    word = np.zeros(n + 2, bool)
    word[1:-1] = inside[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(col: pa.Array, lower: bool = True,
                letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order and, per row, the words before it."""
    raw, at = text_bytes(col)
    table, inside = _tables(letters_only)
    starts, ends, rows = spans(raw, at, inside)
    values = byte_values(1)[table] if lower else byte_values(1)
    # a word is a polynomial in BASE: the difference of two running sums,
    # shifted back to power zero by the inverse of BASE
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(values[raw] * powers(len(raw)), out=total[1:])
    back = powers(len(raw) + 1, pow(BASE, -1, 1 << 64))
    return mix((total[ends] - total[starts]) * back[starts]), rows


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its ``k``-word shingles; a shorter
    row has one shingle, an empty row none."""
    h = words.copy()
    for j in range(1, k):
        h[:-j] = mix(h[:-j] * U64(3) + words[j:]) if len(h) > j else h[:-j]
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a:b - k + 1]))
        elif b > a:
            v = words[a:a + 1].copy()
            for j in range(a + 1, b):
                v = mix(v * U64(3) + words[j:j + 1])
            out.append(v)
        else:
            out.append(np.empty(0, U64))
    return out
