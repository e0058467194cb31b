"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over ``span`` tokens; the tokens at its zeros are
ignored, so a substituted word spoils only the windows that look at it. Test
items are hashed under every mask into a sorted table; training windows join
it by hash, and each hit is verified along its diagonal: the best-scoring run
of aligned tokens (+1 equal, -4 substituted, so at least four in five are equal)
must cover ``overlap`` tokens, or the whole item where that is shorter.

Tokens are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower
case. Items are sent to the workers in blocks of about ``block`` tokens, each
scanned against all rows, so no broadcast grows with the benchmark. Items shorter
than a mask, down to ``SHORT`` tokens, are hashed whole and found word for word;
still shorter ones are left out, since they are common speech.

Rows: one per training row, with all its columns and ``hits``. Null or empty
texts have no hits; an item without an id is a hit without one; a repeated item is a hit of its own; an empty benchmark or
table gives no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import U64, mix, powers, text_chunks, word_hashes
from fieldcast.llm._ship import shipped
from fieldcast.llm._text import free_name

MASKS = ("111010010111", "110110101011", "101111000111", "111100110101")
OVERLAP, SHORT = 13, 6
BLOCK = 1 << 20
HITS = "array<struct<item_id:bigint,doc_start:int,item_start:int,length:int,matched:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()),
                           ("item_start", pa.int32()), ("length", pa.int32()),
                           ("matched", pa.int32())]))
_BITS = 20


def windows(words: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and masked hash of every window that lies in one row."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    factor = powers(len(mask) + 1)
    total = np.zeros(n, U64)
    for j, c in enumerate(mask):
        if c == "1":
            total += words[j:j + n] * factor[j + 1]
    first = np.arange(n)
    row_end = np.repeat(rows[1:], np.diff(rows))[:n]
    ok = first + len(mask) <= row_end
    return first[ok], mix(total[ok])


class ItemBlock:
    """Token hashes of some test items and their sorted masked windows."""

    def __init__(self, ids: list[int | None], texts: pa.Array, masks: tuple[str, ...]):
        self.ids = ids
        self.words, self.rows = word_hashes(texts, letters_only=True)
        size = np.diff(self.rows)
        whole = sorted({n for n in size.tolist() if SHORT <= n < min(map(len, masks))})
        self.masks = (*masks, *("1" * n for n in whole))
        self.seeds = []
        for m in self.masks:
            at, h = windows(self.words, self.rows, m)
            if m not in masks:  # items of just this length
                fits = np.isin(at, self.rows[:-1][size == len(m)])
                at, h = at[fits], h[fits]
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[h >> U64(64 - _BITS)] = True
            self.seeds.append((h[order], at[order], seen))

    def diagonals(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (row, item, text position - item position) of all hits."""
        found = []
        for m, (keys, at, seen) in zip(self.masks, self.seeds):
            pos, h = windows(words, rows, m)
            near = seen[h >> U64(64 - _BITS)]
            pos, h = pos[near], h[near]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo
            if not n.sum():
                continue
            skip = np.repeat(np.cumsum(n) - n, n)
            item_at = at[np.arange(n.sum()) - skip + np.repeat(lo, n)]
            doc_at = np.repeat(pos, n)
            found.append(np.unique(np.stack([
                np.searchsorted(rows, doc_at, "right") - 1,
                np.searchsorted(self.rows, item_at, "right") - 1, doc_at - item_at]), axis=1))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((3, 0), int)

    def hits(self, words: np.ndarray, rows: np.ndarray, overlap: int) -> dict[int, list[dict]]:
        out: dict[int, dict[int, dict]] = {}
        for row, item, shift in self.diagonals(words, rows).T.tolist():
            a, b = int(self.rows[item]), int(self.rows[item + 1])
            lo, hi = max(a, int(rows[row]) - shift), min(b, int(rows[row + 1]) - shift)
            same = words[lo + shift:hi + shift] == self.words[lo:hi]
            run = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
            least = np.minimum.accumulate(run)
            end = int(np.argmax(run - least))
            start = int(np.argmin(run[:end + 1]))
            if end - start >= min(overlap, b - a):
                hit = {"item_id": self.ids[item], "doc_start": lo + shift + start - int(rows[row]),
                       "item_start": lo + start - a, "length": end - start,
                       "matched": int(same[start:end].sum())}
                best = out.setdefault(row, {}).get(item)
                if best is None or (hit["matched"], -hit["doc_start"]) > (best["matched"], -best["doc_start"]):
                    out[row][item] = hit
        return {r: list(v.values()) for r, v in out.items()}


def item_blocks(benchmark: DataFrame, masks: tuple[str, ...], block: int) -> list:
    """Broadcast blocks of items, each of about ``block`` tokens at most."""
    spark = benchmark.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // (2 * block)) + 1  # a token and its gap take two bytes or more
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        if part.num_rows:
            part = part.combine_chunks()
            out.append(spark.sparkContext.broadcast(ItemBlock(
                part["item_id"].to_pylist(), part["text"].combine_chunks(), masks)))
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP,
              masks: tuple[str, ...] = MASKS, block: int = BLOCK, name: str = "hits") -> DataFrame:
    """``docs`` with ``hits``: per row and item the best verified overlap."""
    blocks = item_blocks(benchmark, masks, block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            words, rows = word_hashes(part.column("text"), letters_only=True)
            got: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for b in blocks:
                for r, hit in b.value.hits(words, rows, overlap).items():
                    got[r] += hit
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(got, _HIT)], names=[*part.schema.names, name])

    return shipped(docs).mapInArrow(scan, docs.select("*", F.lit(None).cast(HITS).alias(name)).schema)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: contaminated, item ids and the tokens that match."""
    hit = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    return hit.select("doc_id", (F.size("hits") > 0).alias("contaminated"),
                      F.size("hits").cast("long").alias("n_items"),
                      F.array_sort("hits").alias("hits"))


def clean_only(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark."""
    name = free_name(docs, "hits")
    return with_hits(docs, benchmark, name=name, **options).where(F.size(name) == 0).drop(name)
