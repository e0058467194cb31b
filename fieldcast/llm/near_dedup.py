"""MinHash near-dedup with tensored banding.

Two small collections of ``side`` groups, each of ``depth`` minhashes, take
``2 * side * depth`` minhash values per document. A table key combines one group
of the first collection with one of the second, which gives ``side ** 2`` tables
of ``2 * depth`` values each: about the square root of the minhash work that
so many independent tables would need. A pair meets in some table unless one
collection has no equal group, so at similarity s it is missed with probability
below ``2 * (1 - s ** depth) ** side``.

Documents of equal shingle sets form one class, so copies are never paired. A
shingle that only one class has is in no intersection, which bounds every
similarity from above: classes and pairs that cannot reach the threshold go
before any set is compared. Within a key, classes are first checked against the
key's class with the least share of its own, then against a class of the key's
main component. What is still apart but shares keys forms families; in a
family, every class outside its main component is checked against all others,
in blocks of bounded size whose intersections are counted from posting lists. A
hot key collapses into one component in the first rounds, so no pairs of a hot
group are written out, and no link that changes a component is lost. Every
check is on the full sets.

Rows: one per input row. Texts without a word are linked with nothing. Rows
that share a doc_id count as one document for links; a null doc_id joins the
class of its text, and alone has a null component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import (U64, list_values, mix, shingles, text_chunks,
                                  word_hashes)
from fieldcast.llm._graph import components
from fieldcast.llm._ship import shipped
from fieldcast.session import stored

SIDE, DEPTH = 9, 2
SHINGLE, PERCENT = 5, 80
#: classes of one block in a family
BLOCK = 1024


def signatures(docs: DataFrame, k: int, side: int, depth: int) -> DataFrame:
    """doc_id, n, s1, s2 (a 128-bit digest of the set), left and right group hashes."""
    n_hash = 2 * side * depth
    rng = np.random.default_rng(17)
    a = rng.integers(1, 2**63, n_hash, U64) | U64(1)
    b = rng.integers(0, 2**63, n_hash, U64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            sets = shingles(*word_hashes(part.column("text")), k)
            sizes = np.array([len(x) for x in sets])
            full = np.flatnonzero(sizes)
            groups = np.zeros((len(sets), 2 * side), U64)
            s1, s2 = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
            if len(full):
                flat = np.concatenate(sets)
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                s1[full] = np.add.reduceat(mix(flat + U64(11)), starts)
                s2[full] = np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5A5A5A5A5)), starts)
                for g in range(2 * side):
                    h = np.zeros(len(full), U64)
                    for j in range(g * depth, (g + 1) * depth):
                        x = flat * a[j] + b[j]
                        x ^= x >> U64(29)
                        low = np.minimum.reduceat(x * U64(0x9E3779B97F4A7C15), starts)
                        h = mix(h * U64(3) + low)
                    groups[full, g] = h

            def lists(m: np.ndarray) -> pa.Array:
                at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * side)
                return pa.ListArray.from_arrays(at, pa.array(
                    np.ascontiguousarray(m).view(np.int64).ravel()))

            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(s1.view(np.int64)),
                 pa.array(s2.view(np.int64)), lists(groups[:, :side]), lists(groups[:, side:])],
                names=["doc_id", "n", "s1", "s2", "left", "right"])

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id bigint, n bigint, s1 bigint, s2 bigint, left array<bigint>, right array<bigint>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, items: the sorted shingle hashes of each document."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            got = shingles(*word_hashes(part.column("text")), k)
            at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            items = pa.array(np.concatenate(got).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(at), items)],
                names=["id", "items"])

    return shipped(docs).select("id", "text").mapInArrow(sets, "id bigint, items array<bigint>")


def _keys(classes: DataFrame) -> DataFrame:
    """key, id, n of every class in every table."""
    left = classes.select("id", "n", "right", F.posexplode("left").alias("i", "x"))
    pairs = left.select("id", "n", "i", "x", F.posexplode("right").alias("j", "y"))
    return pairs.select(F.xxhash64("i", "j", "x", "y").alias("key"), "id", "n")


def _shareable(sets: DataFrame) -> DataFrame:
    """id, m: how many shingles of each set some other set has too."""
    own = (sets.select("id", F.explode("items").alias("s")).groupBy("s")
           .agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
           .groupBy("id").agg(F.count(F.lit(1)).alias("own")))
    return (sets.select("id", F.size("items").alias("n")).join(own, "id", "left")
            .select("id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m")))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.select("a", "b").join(x, "a").join(y, "b")
            .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` that can still reach the similarity."""
    most = F.least("ma", "mb")
    return (pairs.where((F.col("a") != F.col("b")) & (100 * most >= percent * (
        F.col("na") + F.col("nb") - most)))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _named(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select(*more, F.col("id").alias(side), F.col("n").alias(f"n{side}"),
                       F.col("m").alias(f"m{side}"))


def class_roots(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """id, root of the classes that are linked with another."""
    keys = _keys(classes.where("n > 0"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = stored(keys.join(shared, "key"), "met")
    texts = (docs.select(F.col("doc_id").cast("long").alias("id"), "text")
             .join(met.select("id").distinct(), "id", "left_semi")
             .groupBy("id").agg(F.min("text").alias("text")))
    sets = stored(shingle_sets(texts, k), "sets")
    met = stored(met.join(_shareable(sets), "id").where(100 * F.col("m") >= percent * F.col("n")),
                 "met")
    # the class with the least of its own is nearest to what the others share
    low = (met.groupBy("key").agg(F.min(F.struct(1 - F.col("m") / F.col("n"), "id", "n", "m")).alias("x"),
                                  F.count(F.lit(1)).alias("c"))
           .where("c > 1").select("key", "x.*"))
    star = _named(met, "a", "key").join(_named(low, "b", "key"), "key")
    roots = components(linked(_possible(star, percent), sets, percent))
    seen, main = _split_keys(met, roots)
    pairs = (_named(seen.join(main, "key").where("root <> main"), "a", "key")
             .join(_named(main.select("key", "top.*"), "b", "key"), "key"))
    # what is known goes on as the root of each class, so only new links are joined up
    roots = components(_hung(roots).unionByName(linked(_possible(pairs, percent), sets, percent)))
    seen, main = _split_keys(met, roots)
    return components(_hung(roots).unionByName(_family_links(seen, main, sets, percent)))


def _hung(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _split_keys(met: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``met`` with each class's root so far; of the keys that meet several roots,
    the root with most classes there and one of its classes with its sizes."""
    seen = stored(met.join(known, "id", "left").select(
        "key", "id", "n", "m", F.coalesce("root", "id").alias("root")), "seen")
    roots = seen.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("id", "n", "m")).alias("top"))
    main = (roots.groupBy("key").agg(F.count(F.lit(1)).alias("roots"),
                                     F.max(F.struct("c", "root", "top")).alias("x"))
            .where("roots > 1").select("key", F.col("x.root").alias("main"), "x.top"))
    return seen, main


def _family_links(seen: DataFrame, main: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A link for every two roots of a family that have one."""
    edges = seen.join(main, "key").where("root <> main").select(
        F.col("root").alias("a"), F.col("main").alias("b"))
    family = components(edges).select(F.col("id").alias("root"), F.col("root").alias("family"))
    members = stored(seen.select("id", "root").distinct().join(family, "root"), "members")
    size = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("c"))
    size = size.groupBy("family").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("x"))
    size = size.select("family", F.col("x.root").alias("main"),
                       F.ceil(F.col("n") / BLOCK).alias("blocks"),
                       F.ceil((F.col("n") - F.col("x.c")) / BLOCK).alias("chunks"))
    rows = members.join(size, "family").join(sets, "id")
    spread = F.xxhash64("id")
    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    own = lambda c: F.pmod(spread, c)
    base = rows.select("family", "id", "root", "items", F.lit(False).alias("asks"),
                       own(F.col("blocks")).alias("block"), every(F.col("chunks")).alias("chunk"))
    asks = (rows.where("root <> main").select(
        "family", "id", "root", "items", F.lit(True).alias("asks"),
        every(F.col("blocks")).alias("block"), "chunks", spread.alias("h"))
        .withColumn("chunk", F.pmod("h", "chunks")).drop("chunks", "h"))

    def check(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, roots = table["id"].to_numpy(), table["root"].to_numpy()
        asking = table["asks"].to_numpy(zero_copy_only=False)
        items, at = list_values(table["items"].combine_chunks())
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        kept = ~asking[owner]
        order = np.argsort(items[kept], kind="stable")
        posted, who = items[kept][order], owner[kept][order]
        out = {}
        for q in np.flatnonzero(asking).tolist():
            mine = items[at[q]:at[q + 1]]
            lo, hi = np.searchsorted(posted, mine, "left"), np.searchsorted(posted, mine, "right")
            c = hi - lo
            take = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)
            both = np.bincount(who[take], minlength=len(n))
            near = np.flatnonzero((100 * both >= percent * (n + n[q] - both)) & (roots != roots[q])
                                  & ~asking)
            for r, first in zip(*np.unique(roots[near], return_index=True)):
                out[min(r, roots[q]), max(r, roots[q])] = (ids[q], ids[near[first]])
        found = list(out.values())
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})

    return (base.unionByName(asks).groupBy("family", "block", "chunk")
            .applyInArrow(check, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, side: int = SIDE,
                    depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed = stored(signatures(docs, k, side, depth), "signatures")
    worded = signed.where("n > 0")
    # rows of one set are equal, so any row's hashes will do
    classes = stored(worded.where("doc_id is not null").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("id"), F.max("n").alias("n"), F.any_value("left").alias("left"),
        F.any_value("right").alias("right")), "classes")
    root = class_roots(docs, classes, k, percent)
    of_set = classes.select("s1", "s2", "id").join(root, "id", "left").select(
        "s1", "s2", F.coalesce("root", "id").alias("component_id"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return (worded.join(of_set, ["s1", "s2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(signed.where("n = 0").select(
                "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
            .withColumn("kept", same))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each component.
    Rows without an id stay too if no row with an id has their text."""
    gone = (near_duplicates(docs, **options)
            .where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone"))
            .distinct())
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
