"""Spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. The bigrams of all words are ranked, rare ones first, and the
first ``PREFIX`` of a word are its prefix. Of any three bigrams two do not
overlap, and a single edit spoils only one of these two, the pivots. So of two
near words the one whose prefix ends earlier in the ranking has a pivot that
stands in the other's prefix.

Where it stands is known as well. The edit is either behind the first pivot,
then both words are equal up to that pivot's end, or before the second pivot,
then they are equal from that pivot on. These position limits go into the join
key: an index row is a prefix bigram together with all that stands on one side
of it, and a word asks for two keys only. Among the pairs of bigrams of the
prefix that do not overlap, dynamic programming over the positions chooses the
pair whose keys the fewest words share, as estimated from how often each bigram
follows the letters before or after it at that distance from the start or end.
What meets is verified by edit distance within the join, after a look at which
letters occur an odd number of times; no pair is written that is not near.

A word's form is its near word of most occurrences, if that has ``ratio`` times
as many; following forms from word to word ends at its root. Occurrences rise
along the way, so there are no circles, and every round of the search halves
what is left.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in
lower case; null and empty texts have none. The table of bigrams has a row per
pair of those 90 letters at most. Words of over 64 code points go by a digest until
their pairs are verified. A text stays in one task. Repeated rows count
each time they occur; an empty table gives no rows. ``typos`` deletes a letter of
some occurrences by a checksum of doc_id and word; a null doc_id counts as an
empty one there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import U64, mix, powers, text_bytes, text_chunks
from fieldcast.llm._ship import shipped
from fieldcast.session import stored

LEAST, OCCURS, RATIO = 7, 2, 10
TYPO = 31
#: distinct words that a task holds before it passes them on
HELD = 1 << 19
#: rarest bigrams of a word that others may ask for: three are enough to be right,
#: more give the choice of pivots that fewer words share
PREFIX = 4
#: distances from a word's start or end that are counted one by one
NEAR = 16
#: code points from which on a word's text does not go with each of its keys
LONG = 64
#: every code point of a word, at its number: a-z, then U+00C0 to U+00FF
_LETTERS = 90


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _letter_bytes(raw: np.ndarray) -> np.ndarray:
    """Bytes of letters: ASCII ones, and both bytes of U+00C0 to U+00FF, which are
    all that UTF-8 starts with 0xC3."""
    low = raw | 0x20
    lead = raw == 0xC3
    inside = ((low >= 97) & (low <= 122) & (raw < 0x80)) | lead
    inside[1:] |= lead[:-1]
    return inside


def checksums(first: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray
              ) -> np.ndarray:
    """CRC-32 of the bytes at each start, carried on from ``first``."""
    order = np.argsort(-sizes, kind="stable")
    state, at = ~first[order].astype(np.uint32), starts[order]
    falling = -sizes[order]
    for j in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(falling, -j, "left"))  # those longer than j
        s = state[:live]
        state[:live] = _CRC[(s ^ data[at[:live] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32).tobytes()),
                                       pa.py_buffer(flat.tobytes()))


def words_of(part: pa.RecordBatch, least: int, typos: bool) -> pa.Array:
    """Every occurrence of a word of at least ``least`` code points."""
    raw, at = text_bytes(part.column("text"))
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _letter_bytes(raw)
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    sizes = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1 - starts
    wide = np.concatenate([[0], np.cumsum(raw == 0xC3)])
    points = sizes - (wide[starts + sizes] - wide[starts])
    keep = points >= least
    starts, sizes, points = starts[keep], sizes[keep], points[keep]
    lower = raw.copy()
    lower[(raw >= 65) & (raw <= 90)] += 32
    if not typos or not len(starts):
        return _gather(lower, starts, sizes)
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode())
                      for i in part.column("doc_id").to_pylist()], np.uint32)
    first = heads[np.searchsorted(at, starts, "right") - 1]
    h = np.empty(len(starts), np.uint32)
    short = sizes <= 256
    h[short] = checksums(first[short], lower, starts[short], sizes[short])
    for i in np.flatnonzero(~short).tolist():
        h[i] = zlib.crc32(lower[starts[i]:starts[i] + sizes[i]].tobytes(), int(first[i]))
    hit = h % TYPO == 0
    made = []
    for i in np.flatnonzero(hit & (points > least)).tolist():
        w = lower[starts[i]:starts[i] + sizes[i]].tobytes().decode()
        k = int(h[i]) % len(w)
        made.append(w[:k] + w[k + 1:])
    return pa.concat_arrays([_gather(lower, starts[~hit], sizes[~hit]), pa.array(made, pa.string())])


def word_counts(docs: DataFrame, least: int = LEAST, occurs: int = OCCURS,
                typos: bool = False) -> DataFrame:
    """word, n: counted within tasks, then over all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            return t.rename_columns({"c_sum": "c"}).select(["word", "c"])

        for part in text_chunks(batches):
            v = pc.value_counts(words_of(part, least, typos))
            held.append(pa.table({"word": v.field(0), "c": v.field(1)}))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].to_batches(1 << 16)
                    held = []
        if held:
            yield from merged().to_batches(1 << 16)

    ids = [F.col("doc_id").cast("long")] if typos else []
    return (shipped(docs).select(*ids, "text").mapInArrow(count, "word string, c bigint")
            .groupBy("word").agg(F.sum("c").alias("n")).where(F.col("n") >= occurs))


class Letters:
    """Code points of words of one length, side by side, as numbers below 90."""

    def __init__(self, words: pa.Array):
        text = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        size = pc.utf8_length(words).to_numpy()
        self.ends = np.cumsum(size)
        self.size, self.text = size, np.where(text < 128, text - 97, text - 166).astype(np.int64)

    def of_length(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have ``n`` code points, and a row of numbers for each."""
        rows = np.flatnonzero(self.size == n)
        return rows, self.text[(self.ends[rows] - n)[:, None] + np.arange(n)]


def _slots(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the bigrams of a word of ``n`` from its start and its end."""
    at = np.arange(n - 1)
    return np.minimum(at, NEAR), np.minimum(n - 2 - at, NEAR)


def gram_tables(words: DataFrame) -> tuple[np.ndarray, ...]:
    """Rank of each bigram, rare first; how many words have it first, or last; and the
    share that has it among those with its inner letter at that distance from the
    start, or from the end."""
    kinds, slots = _LETTERS * _LETTERS, NEAR + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, kinds * slots), np.int64)
        for b in batches:
            letters = Letters(b.column("word"))
            for n in np.unique(letters.size).tolist():
                x = letters.of_length(n)[1]
                g = (x[:, :-1] * _LETTERS + x[:, 1:]) * slots
                for t, d in zip(total, _slots(n)):
                    t += np.bincount((g + d).ravel(), minlength=kinds * slots)
        side, key = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side * kinds * slots + key),
                                          pa.array(total[side, key])], names=["k", "c"])

    rows = (shipped(words).select("word").mapInArrow(count, "k bigint, c bigint")
            .groupBy("k").agg(F.sum("c").alias("c")).toArrow())  # 2 * 90 * 90 * 17 at most
    both = np.zeros(2 * kinds * slots, np.int64)
    both[rows["k"].to_numpy()] = rows["c"].to_numpy()
    left, right = both.reshape(2, _LETTERS, _LETTERS, slots).astype(float)
    rank = np.empty(kinds, np.int64)
    rank[np.lexsort((np.arange(kinds), left.reshape(kinds, slots).sum(1)))] = np.arange(kinds)
    return rank, _chain(left, left.sum(1, keepdims=True)), _chain(right, right.sum(0, keepdims=True))


def _chain(count: np.ndarray, of_letter: np.ndarray) -> np.ndarray:
    """Counts at distance 0, further in the share of the letter that goes on."""
    out = np.divide(count, of_letter, where=of_letter > 0, out=np.zeros(count.shape))
    out[:, :, 0] = count[:, :, 0]
    return out.reshape(_LETTERS * _LETTERS, -1)


def pivots(prefix: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the two places of ``prefix`` that do not overlap and cost least, the
    left one by ``first`` and the right one by ``second``."""
    best = np.full(len(prefix), np.inf)  # cheapest first pivot so far, and its place
    place = np.zeros(len(prefix), np.int64)
    cost, a, b = best.copy(), place.copy(), place.copy()
    for j in range(2, prefix.shape[1]):
        i = j - 2
        better = prefix[:, i] & (first[:, i] < best)
        best, place = np.where(better, first[:, i], best), np.where(better, i, place)
        total = np.where(prefix[:, j], best + second[:, j], np.inf)
        better = total < cost
        cost, a, b = np.where(better, total, cost), np.where(better, place, a), np.where(better, j, b)
    return a, b


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bigram, a hash of the word up to its end and one from it on."""
    n = x.shape[1]
    v = mix(x.astype(U64) + U64(0x51ED270B))
    left = np.cumsum(v * powers(n), axis=1, dtype=U64)[:, 1:]
    right = np.cumsum((v * powers(n)[::-1])[:, ::-1], axis=1, dtype=U64)[:, ::-1][:, :-1]
    place = np.arange(n - 1, dtype=U64)
    return mix(left + place * U64(2)), mix(right ^ mix((U64(n) - place) * U64(2) + U64(1)))


def index_rows(words: DataFrame, tables: tuple[np.ndarray, ...]) -> DataFrame:
    """key, asks, last, odd, name, size, n: two keys a word asks for, and two of each
    bigram of its prefix, whose last bigram's rank is ``last``; ``odd`` has a bit per
    letter (64 of them, shared) that occurs an odd number of times."""
    sent = words.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, left, right = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            letters = Letters(b.column("word"))
            for n in np.unique(letters.size).tolist():
                at, x = letters.of_length(n)
                gram = x[:, :-1] * _LETTERS + x[:, 1:]
                r = rank[gram]
                k = min(PREFIX, n - 1)
                last = np.partition(r, k - 1, axis=1)[:, k - 1]
                prefix = r <= last[:, None]
                from_start, from_end = _slots(n)
                alike = (np.cumprod(left[gram, from_start], axis=1),
                         np.cumprod(right[gram, from_end][:, ::-1], axis=1)[:, ::-1])
                p1, p2 = pivots(prefix, *alike)
                up_to, on = _sides(x)
                odd = np.bitwise_xor.reduce(np.int64(1) << (x % 64), axis=1)
                rows = np.arange(len(at))
                of, place = np.nonzero(prefix)
                key = np.concatenate([up_to[rows, p1], on[rows, p2], up_to[of, place], on[of, place]])
                who = np.concatenate([rows, rows, of, of])
                asks = np.arange(len(who)) < 2 * len(rows)
                if k == n - 1:  # all bigrams are there, none can be missed
                    last = np.where(asks, last[who], _LETTERS * _LETTERS)
                else:
                    last = last[who]
                take = pa.array(at[who])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(asks), pa.array(last.astype(np.int32)),
                     pa.array(odd[who]), b.column("name").take(take), pa.array(np.full(len(who), n, np.int32)),
                     b.column("n").take(take)], names=["key", "asks", "last", "odd", "name", "size", "n"])

    return shipped(words).mapInArrow(
        run, "key bigint, asks boolean, last int, odd bigint, name string, size int, n bigint")


def _named(words: DataFrame) -> DataFrame:
    """word, name, n: a long word goes by a digest, which no word can be equal to."""
    long = F.length("word") > LONG
    return words.select("word", F.when(long, F.concat(F.lit("#"), F.sha2("word", 256)))
                        .otherwise(F.col("word")).alias("name"), "n")


def near_words(words: DataFrame) -> DataFrame:
    """a, na, b, nb: every two words with one edit between them, both ways round."""
    named = _named(words)
    rows = stored(index_rows(named, gram_tables(words)), "pivots")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("last", "odd", "name", "size", "n")]
    is_long = (F.col("name_a").startswith("#") | F.col("name_b").startswith("#"))
    met = (rows.where("asks").select("key", *side("a"))
           .join(rows.where("not asks").select("key", *side("b")), "key")
           # an edit changes whether a letter stands an odd number of times for two at most
           .where((F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2)
                  & (F.col("last_a") <= F.col("last_b"))
                  & (F.abs(F.col("size_a") - F.col("size_b")) <= 1) & (F.col("name_a") != F.col("name_b"))
                  & (is_long | (F.levenshtein("name_a", "name_b", 1) == 1)))
           .select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"),
                   F.when(F.col("name_a") < F.col("name_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("na"),
                   F.when(F.col("name_a") < F.col("name_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("nb"))
           .distinct())
    met = stored(met, "near")
    # pairs with a long word are verified once their texts are fetched
    long = named.where(F.length("word") > LONG).select("name", "word")
    some = met.where(F.col("a").startswith("#") | F.col("b").startswith("#"))
    for c in ("a", "b"):
        some = (some.join(long.withColumnsRenamed({"name": c, "word": f"t{c}"}), c, "left")
                .withColumn(f"t{c}", F.coalesce(f"t{c}", c)))
    some = (some.where(F.levenshtein("ta", "tb", 1) == 1)
            .select(F.col("ta").alias("a"), F.col("tb").alias("b"), "na", "nb"))
    found = met.where(~F.col("a").startswith("#") & ~F.col("b").startswith("#")).unionByName(some)
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("nb").alias("na"),
                                          F.col("a").alias("b"), F.col("na").alias("nb")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the way from form to form.

    Each round replaces a word's goal by its goal's goal, so ways of any length
    end after the logarithm of their number of steps.
    """
    way = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        both = stored(way.join(further, "root", "left"), "ways")
        if both.where("_next is not null").isEmpty():
            return way
        way = both.select("word", F.coalesce("_next", "root").alias("root"))


def variants(docs: DataFrame, least: int = LEAST, occurs: int = OCCURS, ratio: int = RATIO,
             typos: bool = False) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    if least < 4:
        raise ValueError("a prefix of three bigrams needs words of four code points")
    words = stored(word_counts(docs, least, occurs, typos), "words")
    near = near_words(words).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("minus"),
                                                          F.col("b").alias("form"))).alias("best"))
    top = -F.col("best.minus")
    chosen = stored(words.join(near.withColumnRenamed("a", "word"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(top >= ratio * F.col("n"), F.col("best.form")).alias("form"),
        F.when(top >= ratio * F.col("n"), top).alias("form_n")), "forms")
    root = roots(chosen.where("form is not null"))
    return chosen.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
