"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is ``share`` percent of all words. Sources take turns with the weights;
a source whose part would pass ``most`` times its size stops there, and what it
leaves is shared again by weight, until none is above. Sources that stop are
taken whole ``most`` times. The others contest the remaining blocks of ``block``
words: a block goes to the highest quotient ``target / (2 k + 1)``, where ``k``
is what the source has got so far. All blocks are given out at once, by the
quotient down to which exactly that many are accepted; it is searched with sums
over the table of sources, of which there may be any number.

A source's documents are dealt to shards by a seeded hash, one per ``shard``
words and at most ``SHARDS``, and its blocks go to the shards by highest
quotients of their sizes. In a shard the documents follow each other in seeded
order as one row of words, cut into blocks; what the quota has beyond whole
copies is chosen among them by a seeded permutation, so that a block knows by
its number alone whether it is in, and nothing is sorted or gathered for it. A
hot source has many shards; rows move once, with their shard.

Words are runs of characters other than ASCII white space. Null and empty texts
have size 0 and nothing of them is taken; documents without a source are a
source of their own, the last; a null doc_id is dealt by its text; repeated rows
each count. Rows: one per input row, an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldcast.llm._bytes import U64, mix
from fieldcast.llm._ship import shipped
from fieldcast.session import stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 150, 2
BLOCK, SHARD, SEED = 32, 1 << 16, 20
#: shards of one source at most; a larger source has larger shards
SHARDS = 1 << 16
SPANS = "array<struct<first:bigint,length:bigint,copies:bigint>>"
#: quotients tried in one pass over the sources
_TRIED = 24


def with_size(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of words of ``text``."""
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("size", F.coalesce(n, F.lit(0)).cast("long"))


def numbered(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """``rows`` with their number in the order of ``by``, from 0: sorted over the
    cluster, then shifted by what stands in the partitions before."""
    at = stored(rows.orderBy(by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    before, total = {}, 0
    for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
        before[r["p"]], total = total, total + r["c"]
    offset = F.lit(0)
    for p, n in before.items():
        offset = F.when(part == p, F.lit(n)).otherwise(offset)
    return at.withColumn(name, (F.col("_at").bitwiseAND((1 << 33) - 1) + offset).cast("long")).drop("_at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE,
            most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size, number) with target and whether it stops there.

    ``level`` is what a weight of one gets. It only rises from round to round, so
    the sources that stop follow from it. All comparisons are of whole numbers.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("decimal(38,0)") for w in weights]),
                          (F.col("number") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("decimal(38,0)") * most)
    whole = F.lit(0).cast("decimal(38,0)")
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    num, den, stops = 0, 1, F.lit(False)
    while True:
        r = rows.agg(F.coalesce(F.sum(F.when(stops, F.col("_cap"))), whole),
                     F.coalesce(F.sum(F.when(~stops, F.col("_w"))), whole)).first()
        at = (share * int(total) - 100 * int(r[0]), 100 * int(r[1]))
        if at == (num, den) or not at[1]:
            break
        num, den = at
        # hundredths of words over hundredths of weights: exact in whole numbers
        stops = F.col("_w") * F.lit(str(num)).cast("decimal(38,0)") > F.col("_cap") * F.lit(str(den)).cast("decimal(38,0)")
    target = F.when(stops, F.col("_cap").cast("double")).otherwise(
        F.col("_w").cast("double") * F.lit(float(num)) / F.lit(float(den)))
    return rows.withColumn("target", target).withColumn("stops", stops).drop("_w", "_cap")


def accepted(votes: Column, quotient: float) -> Column:
    """How many of ``votes / 1, votes / 3, votes / 5, ...`` reach ``quotient``."""
    return F.floor((votes / F.lit(quotient) + 1) / 2)


def apportioned(parties: DataFrame, seats: int, order: str) -> DataFrame:
    """``parties`` with ``seats``, that many in all by highest quotients of
    ``votes``; of equal last quotients those first in ``order`` win."""
    votes = F.col("votes")
    n, total, top = parties.where("votes > 0").agg(F.count(F.lit(1)), F.sum("votes"), F.max("votes")).first()
    if not n or seats <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    low = total / (2 * seats + n) * 0.999
    high = total / (2 * seats - n) * 1.001 if 2 * seats > n else top * 2
    while True:
        tried = [low, *np.linspace(low, high, _TRIED)[1:-1].tolist()]
        got = parties.agg(*[F.sum(accepted(votes, q)) for q in tried]).first()
        enough = max(i for i, c in enumerate(got) if c >= seats)
        low, high = tried[enough], [*tried, high][enough + 1]
        over = got[enough] - seats
        if not over or math.nextafter(low, high) >= high:
            break
    out = parties.withColumn("seats", F.coalesce(accepted(votes, low), F.lit(0)).cast("long"))
    if over:  # equal quotients: the last in order give theirs back
        losers = (out.where(F.col("seats") > accepted(votes, high)).orderBy(F.col(order).desc())
                  .limit(over).select(F.col(order), F.lit(1).alias("_less")))
        out = (out.join(losers, order, "left")
               .withColumn("seats", F.col("seats") - F.coalesce("_less", F.lit(0))).drop("_less"))
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats of a bounded number of parties by highest quotients, ``most`` at most
    of each; of equal last quotients the first win."""
    if seats >= most.sum():
        return most
    if not votes.sum() or seats <= 0:
        return np.zeros(len(votes), np.int64)
    got = lambda q: np.minimum(most, np.floor((votes / q + 1) / 2).astype(np.int64))
    low, high = votes[votes > 0].min() / (2.0 * most.max() + 1), votes.max() * 2.0
    while (n := got(low)).sum() != seats and (mid := (low + high) / 2) not in (low, high):
        low, high = (mid, high) if got(mid).sum() >= seats else (low, mid)
    over = int(n.sum()) - seats
    if over:
        tied = np.flatnonzero(n > got(high))
        n[tied[len(tied) - over:]] -= 1
    return n


def permuted(x: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each ``x`` in a keyed permutation of the numbers below ``size``:
    four rounds over both halves of its bits, again while the place is outside."""
    half = np.zeros(len(x), U64)
    while (small := (U64(1) << (U64(2) * half)) < size).any():
        half[small] += U64(1)
    mask = (U64(1) << half) - U64(1)
    out, live = x.copy(), np.arange(len(x))
    while len(live):
        v, m, s, k = out[live], mask[live], half[live], key[live]
        left, right = v >> s, v & m
        for r in range(4):
            left, right = right, left ^ (mix(right + k * U64(2 * r + 3) + U64(r)) & m)
        out[live] = left << s | right
        live = live[out[live] >= size[live]]
    return out


def _quotas(shards: DataFrame, block: int, most: int) -> DataFrame:
    """number, shard, words, copies, extra: whole copies of each shard and the blocks
    chosen beyond them."""
    def share(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("shard")  # SHARDS rows at most
        words = table["words"].to_numpy()
        many = -(-words // block)
        seats = sainte_lague(words.astype(float), int(table["seats"][0].as_py()), most * many)
        whole = bool(table["stops"][0].as_py())
        copies = np.full(len(words), most) if whole else np.minimum(
            most, seats * block // np.maximum(words, 1))
        extra = np.rint((seats * block - copies * words) / block).astype(np.int64)
        copies, extra = (np.where(extra >= many, np.minimum(copies + 1, most), copies),
                         np.where(extra >= many, 0, np.maximum(extra, 0)))
        extra[copies == most] = 0
        return pa.table({"number": table["number"], "shard": table["shard"], "words": table["words"],
                         "copies": pa.array(copies.astype(np.int64)), "extra": pa.array(extra)})

    return (shipped(shards).select("number", "shard", "words", "seats", "stops").groupBy("number")
            .applyInArrow(share, "number bigint, shard int, words bigint, copies bigint, extra bigint"))


def _spans(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """``rows`` with taken and spans from their place in their shard."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "length", "copies")]))
    names = ("start", "size", "number", "shard", "words", "copies", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, size, number, shard, words, copies, extra = (
                b.column(f"_{c}").to_numpy() for c in names)
            first = start // block
            n = np.where(size > 0, (start + size - 1) // block - first + 1, 0)
            at = np.concatenate([[0], np.cumsum(n)])
            row = np.repeat(np.arange(len(n)), n)
            number_in = np.arange(at[-1]) - at[row] + first[row]
            key = mix(number.astype(U64) * U64(0x9E3779B97F4A7C15) + shard.astype(U64) * U64(1 << 40)
                      + U64(seed))
            many = (-(-words // block)).astype(U64)
            place = permuted(number_in.astype(U64), many[row], key[row])
            times = copies[row] + (place < extra[row].astype(U64))
            lo = np.maximum(number_in * block, start[row]) - start[row]
            hi = np.minimum((number_in + 1) * block, (start + size)[row]) - start[row]
            taken = np.bincount(row, times * (hi - lo), len(n)).astype(np.int64)
            # neighbouring blocks taken as often are one span
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (times[1:] != times[:-1])
            begin = np.flatnonzero(new)
            length = np.add.reduceat(hi - lo, begin) if len(begin) else begin
            some = times[begin] > 0
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[begin][some], minlength=len(n)))])
            spans = pa.StructArray.from_arrays(
                [pa.array(lo[begin][some]), pa.array(length[some]), pa.array(times[begin][some])],
                fields=list(kind.value_type))
            keep = [c for c in b.schema.names if c[1:] not in names or c[0] != "_"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(taken),
                 pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans)],
                names=[*keep, "taken", "spans"])

    out = rows.drop(*[f"_{c}" for c in names]).select(
        "*", F.lit(0).cast("long").alias("taken"), F.lit(None).cast(SPANS).alias("spans"))
    return shipped(rows).mapInArrow(run, out.schema)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST,
          block: int = BLOCK, shard: int = SHARD, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """row (the columns of ``docs``; without text only doc_id and source), size,
    source_size, target, taken and spans: word ranges and how often each is taken."""
    sized = with_size(docs.select(
        F.struct(*(docs.columns if with_text else ["doc_id", "source"])).alias("row"), "text", "source",
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("spread")))
    sized = stored(sized.drop("text"), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = stored(targets(numbered(sizes, F.col("source").asc_nulls_last(), "number"), weights, share, most),
                   "targets")
    total, stopped = aimed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(
        F.sum(F.when(F.col("stops"), F.col("source_size"))), F.lit(0))).first()
    left = max(0, share * int(total) - 100 * most * int(stopped))
    given = apportioned(aimed.withColumn("votes", F.when(~F.col("stops"), F.col("target"))),
                        (left + 50 * block) // (100 * block), "number")
    given = stored(given.select("source", "source_size", "number", "target", "stops", "seats",
                                F.least(F.ceil(F.col("source_size") / shard), F.lit(SHARDS))
                                .cast("int").alias("shards")), "seats")
    rows = (sized.withColumnRenamed("source", "_source")
            .join(given, F.col("_source").eqNullSafe(F.col("source")))
            .withColumn("shard", F.pmod("spread", F.greatest("shards", F.lit(1))).cast("int"))
            .select("row", "id", "size", "spread", "source_size", "target", "number", "shard", "stops", "seats"))
    shards = rows.groupBy("number", "shard").agg(
        F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("stops").alias("stops"))
    quota = stored(_quotas(shards, block, most), "quotas")
    before = Window.partitionBy("number", "shard").orderBy("spread", "id", "size")
    placed = rows.join(quota, ["number", "shard"]).withColumn(
        "_start", F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    return _spans(placed.select(
        "row", "size", "source_size", "target", F.coalesce("_start", F.lit(0)).alias("_start"),
        F.col("size").alias("_size"), F.col("number").alias("_number"), F.col("shard").alias("_shard"),
        F.col("words").alias("_words"), F.col("copies").alias("_copies"), F.col("extra").alias("_extra")),
        block, seed)


def taken_texts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, first, copy, text: the mix itself, each taken word range as often as
    it is taken, words parted by one space."""
    span = F.explode("spans").alias("span")
    words = F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+)"))
    return (mixed(docs, **options).where("taken > 0").select(
        F.col("row.doc_id").alias("doc_id"), words.alias("words"), span)
        .select("doc_id", F.col("span.first").alias("first"),
                F.explode(F.sequence(F.lit(1), F.col("span.copies"))).alias("copy"),
                F.array_join(F.slice("words", (F.col("span.first") + 1).cast("int"),
                                     F.col("span.length").cast("int")), " ").alias("text")))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    return mixed(docs, with_text=False, **options).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")
