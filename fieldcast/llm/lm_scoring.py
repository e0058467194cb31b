"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to levels that grow by about a
fifth; an n-gram of level q is put into a Bloom filter as (n-gram, 1) to
(n-gram, q). A count is found by probing level after level until one is missing,
so errors only ever raise a count. The filter consists of parts by the top bits
of the key, each with twelve bits per insert of its own, at every size of the
corpus. If all parts together take at most ``bound`` bytes, which is measured,
they are broadcast and probed where the text is. Beyond, the distinct n-grams of
each block of texts are sent to their parts and levels come back; both ways give
the same levels.

The model is a bigram with absolute discounting: ``(c(v,w) - D) / c(v)`` of the
pair plus the mass that the kept pairs of ``v`` leave over times the word's own
smoothed probability. Pairs of all words are counted and kept, also those met
once, unless the caller asks for ``least`` occurrences.

Words and pairs are counted by share of their hashes, in as many shares as the
text asks for; a task sums what it holds and passes it on as one compressed value
per share. The task that sums a share also builds its part of the filter, so
counts of pairs are written nowhere. Words that make up at least one in 2**20
tokens (so 2**20 of them at most) are looked up in a broadcast table; the exact
counts of all others lie beside their part of the filter and are asked for
together with it. ``base_score`` is exact.

Words are told apart by 64-bit hashes, pairs and keys of the filter by 48 bits.
Null and empty texts have the end token only. A null doc_id counts as training.
One row per input row; an empty table gives none, and a table without training
rows has N = V = 0 and uniform scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import U64, mix, text_chunks, word_hashes
from fieldcast.llm._ship import shipped
from fieldcast.session import stored

HEAVY_BITS = 20
DISCOUNT, LEAST = 0.8, 1
#: bytes of a filter that is broadcast
BOUND = 64 << 20
#: bits of the filter per insert
ROOM = 12
END = U64(0x51AB7E0F0D3C2B19)
_WORD = U64(0x1357)
#: a key of the filter has 48 bits at the top; the lowest marks what a word leaves over
_TOP, _CONTEXT = U64(0xFFFFFFFFFFFF0000), U64(1)
#: distinct keys a task holds before it passes them on
HELD = 1 << 21
#: distinct keys a task merges at once, about forty bytes each
SHARE_BITS = 20
#: bytes of text whose questions are asked together
BLOCK = 24 << 20


def _levels() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, out[-1] * 6 // 5))
    return np.array(out[:-1], np.int64)


LEVELS = _levels()
#: the count that a level stands for: the middle of its range
MEANS = np.array([0.0, *[(a + b - 1) / 2 for a, b in pairwise(LEVELS.tolist())], float(LEVELS[-1])])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and the end token; starts of the rows."""
    words, rows = word_hashes(col)
    return np.insert(words, rows[1:], END), rows + np.arange(len(rows))


def pair_keys(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of neighbouring tokens of one row, and the place of
    each pair's second token."""
    ok = np.ones(max(len(flat) - 1, 0), bool)
    ok[rows[1:-1] - 1] = False
    where = np.flatnonzero(ok) + 1
    return mix(flat[where - 1] * U64(3) + flat[where]) & _TOP, where


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _WORD) & _TOP


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, rising: by a sort in place, as ``np.unique`` holds a hash table
    of them."""
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


# -- numbers as compressed values ---------------------------------------------
def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that what is alike stands together, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(data[4:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def gaps(x: np.ndarray) -> bytes:
    """Rising numbers."""
    return packed(np.diff(x, prepend=U64(0)))


def rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U64), dtype=U64)


def _cuts(share: np.ndarray) -> np.ndarray:
    """Where the runs of equal shares start, and the end."""
    return np.append(np.flatnonzero(np.diff(share, prepend=-1)), len(share))


# -- the filter ---------------------------------------------------------------
class Part:
    """One part of the log-frequency Bloom filter: two bits per (key, level)."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, U64(8 * len(bits))

    @staticmethod
    def _places(keys: np.ndarray, at_level: int, size: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + U64(0x9E3779B97F4A7C15 * at_level & (1 << 64) - 1))
        return (h & U64(0xFFFFFFFF)) % size, (h >> U64(32)) % size

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Part:
        q = level(counts)
        size = U64(max(64, -(-ROOM * int(q.sum()) // 64) * 64))
        bits = np.zeros(int(size), bool)
        for k in range(1, int(q.max(initial=0)) + 1):
            keys, q = keys[q >= k], q[q >= k]
            for p in cls._places(keys, k, size):
                bits[p.astype(np.int64)] = True
        return cls(np.packbits(bits, bitorder="little"))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probed until one is missing."""
        found = np.zeros(len(keys), np.uint8)
        live = np.arange(len(keys))
        look = lambda p: (self.bits[p >> U64(3)] >> (p & U64(7)).astype(np.uint8)) & 1
        for q in range(1, len(LEVELS) + 1):
            a, b = self._places(keys[live], q, self.size)
            live = live[(look(a) & look(b)).astype(bool)]
            if not len(live):
                break
            found[live] = q
        return found


class Parts:
    """All parts of one kind, by the top ``bits`` bits of what they are looked up by."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.bits = bits
        self.parts = {s: Part(np.frombuffer(b, np.uint8)) for s, b in parts.items()}

    def levels(self, by: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Levels of ``keys``, whose parts follow from the rising ``by``."""
        out = np.zeros(len(keys), np.uint8)
        share = (by >> U64(64 - self.bits)).astype(np.int64)
        for a, b in pairwise(_cuts(share).tolist()):
            if share[a] in self.parts:
                out[a:b] = self.parts[share[a]].levels(keys[a:b])
        return out


# -- counting -----------------------------------------------------------------
class Table:
    """Sorted hashes with a value each."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.keys, self.values = hashes[order], values[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def get(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, 0 if it is not there."""
        at, there = self.find(h)
        return np.where(there, self.values[at], 0) if len(self.keys) else np.zeros(len(h), np.int64)


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys in order, what goes with each, and the sums of counts, which come last.
    Empties ``held``: a column's pieces go once they are joined."""
    cols = [list(x) for x in zip(*held)]
    held.clear()

    def column() -> np.ndarray:
        return np.concatenate(cols.pop(0))

    keys = column()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    keys, at = keys[first], order[first]
    more = [column()[at] for _ in cols[:-1]]
    counts = column()[order].astype(np.int64)
    return keys, *more, np.add.reduceat(counts, first) if len(first) else counts


def _small(c: np.ndarray) -> list[bytes]:
    """Counts in a byte each; those of 255 and more follow."""
    return [packed(np.minimum(c, 255).astype(np.uint8)), packed(c[c >= 255])]


def _counts(small: bytes, large: bytes) -> np.ndarray:
    out = unpacked(small, np.uint8).astype(np.int64)
    out[out == 255] = unpacked(large, np.int64)
    return out


def _word_shares(docs: DataFrame, bits: int) -> DataFrame:
    """share, h, c: all words with their counts, a row per share."""
    def block(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        share = (h >> U64(64 - bits)).astype(np.int64)
        at = list(pairwise(_cuts(share).tolist()))
        cs = [_small(c[a:b]) for a, b in at]
        return pa.RecordBatch.from_arrays(
            [pa.array([share[a] for a, _ in at], pa.int32()), pa.array([gaps(h[a:b]) for a, b in at], pa.binary()),
             pa.array([x for x, _ in cs], pa.binary()), pa.array([x for _, x in cs], pa.binary())],
            names=["share", "h", "c", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in text_chunks(batches):
            held.append(np.unique(tokens(part.column("text"))[0], return_counts=True))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield block(*held[0])
                    held = []
        if held:
            yield block(*_merged(held))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(rising(h), _counts(c, more)) for b in batches for h, c, more in zip(
            *(b.column(x).to_pylist() for x in ("h", "c", "more")))]
        if held:
            yield block(*_merged(held))

    kind = "share int, h binary, c binary, more binary"
    return stored(docs.select("text").mapInArrow(count, kind)
                  .repartitionById(1 << bits, F.col("share")).mapInArrow(total, kind), "word-counts")


def _heavy(shares: DataFrame, least: int) -> Table:
    """The words of ``least`` occurrences or more; the caller bounds their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c, more in zip(*(b.column(x).to_pylist() for x in ("h", "c", "more"))):
                keys, counts = rising(h), _counts(c, more)
                top = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])],
                                                 names=["h", "c"])

    rows = shares.mapInArrow(run, "h bigint, c bigint").toArrow()
    return Table(rows["h"].to_numpy().view(U64), rows["c"].to_numpy())


def _pair_parts(docs: DataFrame, bits: int, word_bits: int, sent, least: int) -> DataFrame:
    """kind 0: the filter's part of each share of pairs; kind 1: by share of words, how
    many kept pairs a first word has in it, and their counts' sum."""
    def block(k: np.ndarray, v: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        share = (k >> U64(64 - bits)).astype(np.int64)
        cols: list[list] = [[], [], [], [], [], []]
        for a, b in pairwise(_cuts(share).tolist()):
            # a frequent first word goes by its number in the table of such words
            at, there = sent.value.find(v[a:b])
            row = [int(share[a]), gaps(k[a:b]), packed(np.where(there, at + 1, 0).astype(np.uint32)),
                   packed(v[a:b][~there]), *_small(c[a:b])]
            for x, y in zip(cols, row):
                x.append(y)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])],
                                          names=["share", "pair", "known", "v", "c", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in text_chunks(batches):
            flat, rows = tokens(part.column("text"))
            k, where = pair_keys(flat, rows)
            k, first, c = np.unique(k, return_index=True, return_counts=True)
            held.append((k, flat[where[first] - 1], c))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield block(*held[0])
                    held = []
        if held and len((last := _merged(held))[0]):
            yield block(*last)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, share = [], -1
        for b in batches:
            for s, k, known, v, c, more in zip(*(b.column(x).to_pylist() for x in b.schema.names)):
                share, at = s, unpacked(known, np.uint32).astype(np.int64)
                first = np.empty(len(at), U64)
                first[at > 0] = sent.value.keys[at[at > 0] - 1]
                first[at == 0] = unpacked(v, U64)
                held.append((rising(k), first, _counts(c, more)))
        if not held:
            return
        k, v, c = _merged(held)
        k, v, c = k[c >= least], v[c >= least], c[c >= least]
        v, at, n = np.unique(v, return_inverse=True, return_counts=True)
        total = np.bincount(at, c, len(v)).astype(np.int64)
        of = (v >> U64(64 - word_bits)).astype(np.int64)
        cuts = list(pairwise(_cuts(of).tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, *[1] * len(cuts)], pa.int32()),
             pa.array([share, *(int(of[a]) for a, _ in cuts)], pa.int32()),
             pa.array([Part.of(k, c).bits.tobytes(), *(gaps(v[a:b]) for a, b in cuts)], pa.binary()),
             pa.array([b"", *(packed(n[a:b]) for a, b in cuts)], pa.binary()),
             pa.array([b"", *(packed(total[a:b]) for a, b in cuts)], pa.binary())],
            names=["kind", "share", "data", "n", "total"])

    return stored(docs.select("text").mapInArrow(
        count, "share int, pair binary, known binary, v binary, c binary, more binary")
        .repartitionById(1 << bits, F.col("share")).mapInArrow(
            total, "kind int, share int, data binary, n binary, total binary"), "pair-parts")


def _word_parts(shares: DataFrame, sums: DataFrame, bits: int, discount: float) -> DataFrame:
    """share, data, h, c, more: the filter's part of each share of words, for what they
    count and for what their kept pairs leave over, and their exact counts."""
    none = F.lit(None).cast("binary")
    rows = (shares.select("share", F.lit(0).alias("turn"), "h", "c", "more", none.alias("n"), none.alias("total"))
            .unionByName(sums.select("share", F.lit(1).alias("turn"), F.col("data").alias("h"), none.alias("c"),
                                     none.alias("more"), "n", "total")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for b in batches:
            for share, turn, h, c, more, n, total in zip(*(b.column(x).to_pylist() for x in b.schema.names)):
                if turn == 0:
                    own = (share, h, c, more)
                else:
                    held.append((rising(h), unpacked(total, np.int64) - discount * unpacked(n, np.int64)))
        if own is None:
            return
        keys, counts = rising(own[1]), _counts(*own[2:])
        taken = np.zeros(len(keys))
        for v, s in held:
            taken[np.searchsorted(keys, v)] += s
        rest = np.maximum(np.rint(counts - taken), 1).astype(np.int64)
        k = word_keys(keys)
        part = Part.of(np.concatenate([k, k | _CONTEXT]), np.concatenate([counts, rest]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([own[0]], pa.int32()), pa.array([part.bits.tobytes()], pa.binary()),
             *(pa.array([x], pa.binary()) for x in own[1:])], names=["share", "data", "h", "c", "more"])

    return stored(rows.repartitionById(1 << bits, F.col("share")).sortWithinPartitions("share", "turn")
                  .mapInArrow(build, "share int, data binary, h binary, c binary, more binary"), "word-parts")


class Model(NamedTuple):
    """Parts of the filter as written tables, and what all tasks may hold."""

    pairs: DataFrame
    words: DataFrame
    bits: int
    word_bits: int
    heavy: Table
    n: int
    v: int
    discount: float
    bytes: int


def train(docs: DataFrame, discount: float = DISCOUNT, least: int = LEAST) -> Model:
    """The model of the rows of ``docs``."""
    shipped(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    guess = size[0] // 6 + size[1] + 1  # tokens, about; shares need not be exact
    bits = max(6, math.ceil(math.log2(guess)) - SHARE_BITS)
    word_bits = max(5, bits - 2)
    shares = _word_shares(docs, word_bits)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [_counts(*x) for x in zip(b.column("c").to_pylist(), b.column("more").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in c], pa.int64()),
                                              pa.array([len(x) for x in c], pa.int64())], names=["n", "v"])

    n, v = shares.select("c", "more").mapInArrow(sums, "n bigint, v bigint").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    heavy = _heavy(shares, max(1, -(-n >> HEAVY_BITS)))
    sent = docs.sparkSession.sparkContext.broadcast(heavy)
    pairs = _pair_parts(docs, bits, word_bits, sent, least)
    words = _word_parts(shares, pairs.where("kind = 1"), word_bits, discount)
    pairs = pairs.where("kind = 0").select("share", "data")
    total = sum(t.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0] for t in (pairs, words))
    return Model(pairs, words, bits, word_bits, heavy, int(n), int(v), discount, int(total))


# -- scoring ------------------------------------------------------------------
class Asked:
    """What some texts have to know: their distinct words and pairs, in order."""

    def __init__(self, part: pa.RecordBatch):
        flat, self.rows = tokens(part.column("text"))
        self.words, self.word_at = np.unique(flat, return_inverse=True)
        pairs, self.where = pair_keys(flat, self.rows)
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)


def _keys_of(part: pa.RecordBatch, known: Table | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and pairs of a part; with ``known`` only the words it lacks, no pairs."""
    flat, rows = tokens(part.column("text"))
    words = distinct(flat.copy())
    if known is not None:
        return words[~known.find(words)[1]], words[:0]
    return words, distinct(pair_keys(flat, rows)[0])


def _joined(held: list[np.ndarray], keys: np.ndarray) -> None:
    """Adds distinct keys to ``held``, whose lists are joined when they are of like
    length, so that the keys of many parts are held about once."""
    while held and len(held[-1]) < 2 * len(keys):
        keys = distinct(np.concatenate([held.pop(), keys]))
    held.append(keys)


def _all_asked(parts: list[pa.RecordBatch], known: Table | None) -> list[np.ndarray]:
    """The keys that a block asks for: what ``_answers`` tells is in their order."""
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for part in parts:
        for h, keys in zip(held, _keys_of(part, known)):
            _joined(h, keys)
    return [distinct(np.concatenate(h)) if h else np.empty(0, U64) for h in held]


def _answers(blocks: DataFrame, model: Model, sent, local: bool) -> DataFrame:
    """block, kind, share, levels, rests, counts: what the parts tell about the keys of
    each block, in the keys' order: of pairs (kind 0, unless ``local``) their levels, of
    words (kind 1; if ``local``, only those not in the broadcast table) theirs, those of
    what they leave over, and exact counts."""
    n_pairs, kinds = 1 << model.bits, ((1 << model.bits, model.word_bits), (0, model.bits))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for part in text_chunks(batches):
            block = part.column("block").to_numpy()
            for b in np.unique(block).tolist():
                held = of.setdefault(b, ([], []))
                for h, keys in zip(held, _keys_of(part.filter(pa.array(block == b)), sent.value[0] if local else None)):
                    _joined(h, keys)
        for b in list(of):
            rows = []
            for (first, bits), held in zip(kinds, of.pop(b)):
                keys = distinct(np.concatenate(held))
                share = (keys >> U64(64 - bits)).astype(np.int64)
                rows += [(first + int(share[x]), gaps(keys[x:y])) for x, y in pairwise(_cuts(share).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([b] * len(rows), pa.int32()),
                 *(pa.array([x] * len(rows), pa.binary()) for x in (None, None, None)),
                 pa.array([k for _, k in rows], pa.binary())],
                names=["share", "block", "h", "c", "more", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, exact = None, None, None  # a share's own row comes before its questions

        def reply(share: int, block: int, keys: np.ndarray) -> tuple:
            known = of == share
            if share < n_pairs:
                got = part.levels(keys) if known else np.zeros(len(keys), np.uint8)
                return block, 0, share, packed(got), None, None
            k = word_keys(keys)
            got = [part.levels(x) if known else np.zeros(len(keys), np.uint8) for x in (k, k | _CONTEXT)]
            c = exact.get(keys) if known else np.zeros(len(keys), np.int64)
            return block, 1, share, *map(packed, got), packed(c)

        for b in batches:
            out = []
            for share, block, h, c, more, data in zip(*(b.column(x).to_pylist() for x in b.schema.names)):
                if block < 0:
                    of, part = share, Part(np.frombuffer(data, np.uint8))
                    exact = None if h is None else Table(rising(h), _counts(c, more))
                else:
                    out.append(reply(share, block, rising(data)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int32()) for x in cols[:3]), *(pa.array(x, pa.binary()) for x in cols[3:])],
                    names=["block", "kind", "share", "levels", "rests", "counts"])

    none = F.lit(None).cast("binary")
    own = [model.words.select((F.col("share") + n_pairs).alias("share"), F.lit(-1).alias("block"), "h", "c", "more", "data")]
    if not local:
        own.append(model.pairs.select("share", F.lit(-1).alias("block"), none.alias("h"), none.alias("c"),
                                      none.alias("more"), "data"))
    rows = blocks.mapInArrow(ask, "share int, block int, h binary, c binary, more binary, data binary")
    for x in own:
        rows = x.unionByName(rows)
    return (rows.repartitionById(n_pairs + (1 << model.word_bits), F.col("share"))
            .sortWithinPartitions("share", "block").mapInArrow(
                answer, "block int, kind int, share int, levels binary, rests binary, counts binary"))


def _block_scores(texts: pa.Table, told: pa.Table, heavy: Table, probed: tuple[Parts, Parts] | None, total: int,
                  discount: float) -> pa.Table:
    """The sums of a block's rows from what was told about its keys. Of the whole block
    only the texts, the distinct keys and a level each are held; what goes by the token
    is made for one part at a time."""
    told = told.sort_by([("kind", "ascending"), ("share", "ascending")])
    kind = told["kind"].to_numpy()
    got = [{c: np.concatenate([unpacked(x, t) for x in told[c].filter(pa.array(kind == k)).to_pylist()])
            for c, t in cols if (kind == k).any()}
           for k, cols in ((0, [("levels", np.uint8)]),
                           (1, [("levels", np.uint8), ("rests", np.uint8), ("counts", np.int64)]))]
    parts = list(text_chunks(texts.combine_chunks().to_batches()))
    words, pairs = _all_asked(parts, heavy if probed else None)
    out = []
    for part in parts:
        a = Asked(part)
        exact = heavy.get(a.words)
        asked = ~heavy.find(a.words)[1] if probed else np.ones(len(a.words), bool)
        at = np.searchsorted(words, a.words[asked])
        if len(at):
            exact[asked] = got[1]["counts"][at]
        levels = _probed(a, probed) if probed else (
            got[1]["levels"][at], got[1]["rests"][at],
            got[0]["levels"][np.searchsorted(pairs, a.pairs)] if len(a.pairs) else np.zeros(0, np.uint8))
        out.append(_rows(part.column("doc_id"), a, exact, levels, total, discount))
    return pa.Table.from_batches(out)


def _log_sums(a: Asked, word: np.ndarray, rest: np.ndarray, pair: np.ndarray, total: int,
              discount: float) -> np.ndarray:
    """The logarithms of each row's token probabilities, summed, from the levels of the
    distinct words, of what they leave over, and of the distinct pairs."""
    word, rest, pair = MEANS[word], MEANS[rest], MEANS[pair][a.pair_at]
    p = ((word + 1) / total)[a.word_at]
    before = a.word_at[a.where - 1]
    of_word = np.maximum(word, 1)[before]
    seen = np.minimum(np.maximum(pair - discount, 0) / of_word, 1)
    # a word that was never met has no pairs and leaves all
    left = np.where(word[before] > 0, np.minimum(np.maximum(rest[before], 1) / of_word, 1), 1)
    p[a.where] = np.minimum(seen + left * p[a.where], 1)
    return np.add.reduceat(np.log10(p), a.rows[:-1])  # every row has its end token


def scored(docs: DataFrame, model: Model, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    row. The filter is broadcast if it has ``bound`` bytes at most."""
    local = model.bytes <= bound
    total, discount = model.n + model.v + 1, model.discount
    parts = None
    if local:
        rows = [{r["share"]: bytes(r["data"]) for r in t.select("share", "data").collect()}
                for t in (model.pairs, model.words)]
        parts = (Parts(model.bits, rows[0]), Parts(model.word_bits, rows[1]))
    sent = docs.sparkSession.sparkContext.broadcast((model.heavy, parts))
    rows = shipped(docs).select(F.col("doc_id").cast("long"), "text")
    # every word is in the table: nothing has to be asked
    if local and len(model.heavy.keys) == model.v:
        return _scored_rows(rows.mapInArrow(_local_scores(sent, total, discount), _SCORES), model.n)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(size // BLOCK) + 1, docs.sparkSession.sparkContext.defaultParallelism)
    # one exchange serves the questions and the texts that wait for the answers
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "block")
    answers = _answers(blocks, model, sent, local)

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        return _block_scores(texts, told, *sent.value, total, discount)

    # a block without a word that has to be asked has no answers
    met = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORES)
    return _scored_rows(met, model.n)


_SCORES = "doc_id bigint, n bigint, known bigint, base double, score double"


def _probed(a: Asked, parts: tuple[Parts, Parts]) -> tuple[np.ndarray, ...]:
    """Levels of the words, of what they leave over, and of the pairs, from the
    broadcast filter."""
    k = word_keys(a.words)
    return (parts[1].levels(a.words, k), parts[1].levels(a.words, k | _CONTEXT), parts[0].levels(a.pairs, a.pairs))


def _rows(ids: pa.Array, a: Asked, exact: np.ndarray, levels: tuple[np.ndarray, ...], total: int,
          discount: float) -> pa.RecordBatch:
    sums = lambda x: np.add.reduceat(x, a.rows[:-1])  # noqa: E731  every row has its end token
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(a.rows)), pa.array(sums((exact > 0).astype(np.int64)[a.word_at])),
         pa.array(sums(np.log10((exact + 1) / total)[a.word_at])),
         pa.array(_log_sums(a, *levels, total, discount))], names=["doc_id", "n", "known", "base", "score"])


def _local_scores(sent, total: int, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            a = Asked(part)
            yield _rows(part.column("doc_id"), a, sent.value[0].get(a.words), _probed(a, sent.value[1]), total, discount)

    return run


def _scored_rows(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n").alias("n_tokens"),
                       F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       F.col("base").alias("base_score"), "score")


def report(docs: DataFrame, bound: int = BOUND, **options) -> DataFrame:
    """Trains on the rows that are not held out and scores all."""
    return scored(docs, train(docs.where(~held_out(F.col("doc_id"))), **options), bound)
