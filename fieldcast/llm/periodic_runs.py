"""Periodic runs by uniting suffix classes in order of falling common prefixes.

The suffixes of a text's words are sorted; each neighbouring pair in that order
is an edge whose weight is their common prefix. Edges are taken by falling
weight, and a union-find joins the classes of suffixes they connect. A class
keeps its positions in order. When two classes join at weight ``l``, positions
``i < j`` that become neighbours have exactly ``l`` words in common, so the
words from ``i`` to ``j + l`` repeat with period ``j - i``. Such a pair at a
distance within ``l / (least - 1)`` seeds a run of ``least`` periods or more. No
other position of the class lies between the two, and so the period is the
smallest; the common prefix ends where the run does; a seed whose left neighbour
also repeats belongs to a run that starts earlier and is left out. Every run is
seeded by its first position and the one a period further.

Only words whose next ``w`` words occur twice in the text can be in an edge that
matters, ``w`` being the least common prefix of a seed. They are found for a
batch of texts at once; the order and the classes are built for those texts, and
only over those positions.

Words are runs of characters other than ASCII white space, told apart by 64-bit
hashes. A text stays in one task, whose memory is eight bytes per word and level
of ranks (the logarithm of its longest repeat) beside forty times a batch of
texts; nothing is shuffled. One row per input row:
null and empty texts have no words and no runs, a null doc_id is never made
periodic, repeated rows are rows of their own, an empty table gives none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import U64, mix, text_chunks, word_hashes
from fieldcast.llm._ship import shipped
from fieldcast.llm._text import free_name

#: least length of a run in words, and in periods
WORDS, PERIODS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: a class that takes in more positions than this is sorted anew
_FEW = 64


def least_prefix(words: int, periods: int) -> int:
    """The least common prefix of a position and the one a period further."""
    return min(max(words - q, (periods - 1) * q) for q in range(1, words + 1))


def recurring(words: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Positions whose next ``width`` words occur again in the same row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    h = mix(words[:n] + row[:n].astype(U64) * U64(0x9E3779B97F4A7C15))
    for j in range(1, width):
        h = mix(h * U64(3) + words[j:j + n])
    at = np.flatnonzero(row[:n] == row[width - 1:])
    _, which, c = np.unique(h[at], return_inverse=True, return_counts=True)
    return at[c[which] > 1]


def _ranks(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Ranks of the windows of 1, 2, 4, ... words at every position, until no two of
    the positions ``at`` have a window in common. A window cut off by the end comes
    before all that go on, and is equal to none."""
    levels = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    h, n = 1, len(words)
    while len(np.unique(levels[-1][at])) < len(at):
        low = levels[-1]
        further = np.zeros(n, np.int64)
        further[:max(n - h, 0)] = low[h:] + 1
        levels.append(np.unique(low * (n + 1) + further, return_inverse=True)[1])
        h *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b``, told apart by the widest windows,
    have in common: window by window from wide to narrow."""
    out = np.zeros(len(a), np.int64)
    n = len(levels[0])
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + out, b + out
        inside = np.flatnonzero((x < n) & (y < n))
        same = levels[k][x[inside]] == levels[k][y[inside]]
        out[inside[same]] += 1 << k
    return out


def seeds(order: np.ndarray, prefixes: np.ndarray, least: int, periods: int
          ) -> Iterator[tuple[int, int, int]]:
    """Position, distance and common prefix of every pair that becomes neighbours
    close enough to seed a run."""
    edges = np.flatnonzero(prefixes >= least)
    edges = edges[np.argsort(-prefixes[edges], kind="stable")]
    parent = list(range(len(order)))
    members: list[list[int] | None] = [[x] for x in order.tolist()]
    for e, l in zip(edges.tolist(), prefixes[edges].tolist()):
        a, b = e, e + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b], members[b] = a, None
        reach, last = l // (periods - 1), len(small) - 1
        for k, x in enumerate(small):
            i = bisect_left(large, x)
            if i and 0 < x - large[i - 1] <= reach and (k == 0 or small[k - 1] < large[i - 1]):
                yield large[i - 1], x - large[i - 1], l
            if i < len(large) and large[i] - x <= reach and (k == last or small[k + 1] > large[i]):
                yield x, large[i] - x, l
        if len(small) > _FEW:
            large += small
            large.sort()
        else:
            for x in small:
                large.insert(bisect_left(large, x), x)


def runs_of(words: np.ndarray, at: np.ndarray, least_words: int = WORDS,
            periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of one text, in order; ``at``
    are its recurring positions."""
    least = least_prefix(least_words, periods)
    levels = _ranks(words, at)
    order = at[np.argsort(levels[-1][at])]
    prefixes = common_prefixes(levels, order[:-1], order[1:])
    kind = levels[0]
    return sorted((i, q + l, q) for i, q, l in seeds(order, prefixes, least, periods)
                  if q + l >= max(least_words, periods * q)
                  and (i == 0 or kind[i - 1] != kind[i + q - 1]))


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """For documents chosen by id, the original word that each place takes."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _texts(part: pa.RecordBatch) -> Iterator[list[bytes]]:
    for t in part.column("text").cast(pa.large_binary()).to_pylist():
        yield (t or b"").split()  # bytes split at ASCII white space


def _found(part: pa.RecordBatch, planted: bool, words: int, periods: int):
    """Per row: words' origins (null: as they are), runs."""
    flat, rows = word_hashes(part.column("text"), lower=False)
    ids = part.column("doc_id").to_pylist() if planted else [None] * part.num_rows
    origin = [made_periodic(i, n) for i, n in zip(ids, np.diff(rows).tolist())]
    for k, o in enumerate(origin):
        if o is not None:
            flat[rows[k]:rows[k + 1]] = flat[rows[k]:rows[k + 1]][o]
    at = recurring(flat, rows, least_prefix(words, periods))
    cut = np.searchsorted(at, rows)
    for k, o in enumerate(origin):
        mine = at[cut[k]:cut[k + 1]] - rows[k]
        yield o, runs_of(flat[rows[k]:rows[k + 1]], mine, words, periods) if len(mine) else []


def with_runs(docs: DataFrame, words: int = WORDS, periods: int = PERIODS,
              name: str | None = None) -> DataFrame:
    """``docs`` with the maximal runs of each text's words, by start and period."""
    name = name or free_name(docs, "runs")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            got = [[dict(zip(("start", "length", "period"), r)) for r in runs]
                   for _, runs in _found(part, False, words, periods)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, kind)],
                                             names=[*part.schema.names, name])

    return shipped(docs).mapInArrow(scan, docs.select("*", F.lit(None).cast(RUNS).alias(name)).schema)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what follows the first period of a run."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]


def report(docs: DataFrame, words: int = WORDS, periods: int = PERIODS) -> DataFrame:
    """Per document, some of them made periodic by their id: the runs, the longest
    of them, and digests of all runs and of the collapsed text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            count, best, listed, rest = [], [], [], []
            for text, (origin, runs) in zip(_texts(part), _found(part, True, words, periods)):
                if origin is not None:
                    text = [text[i] for i in origin.tolist()]
                top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
                count.append(len(runs))
                best.append((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
                listed.append(sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                rest.append(sha256(b" ".join(collapsed(text, runs))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(count, pa.int64()),
                 *(pa.array(c, pa.int64()) for c in zip(*best)), pa.array(listed), pa.array(rest)],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                       "runs_sha256", "collapsed_sha256"])

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
              "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
