"""Connected components of a link table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._ship import shipped
from fieldcast.session import stored

#: links a task joins up at once, about forty bytes each
HELD = 1 << 20


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links but the smallest of its component, and that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[:len(a)], at[len(a):], np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    hung = np.flatnonzero(root != np.arange(len(ids)))
    return ids[hung], ids[root[hung]]


def _spanning(links: DataFrame) -> DataFrame:
    """Links ``a > b`` with the same components: a task hangs the ids of the links that
    it meets on the smallest they reach by them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(x) for x, _ in held) > HELD:
                held = [joined_up(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield row(*held.pop())
        if held:
            yield row(*joined_up(*map(np.concatenate, zip(*held))))

    pairs = shipped(links).select(F.col("a").cast("long"), F.col("b").cast("long"))
    return stored(pairs.where("a <> b").mapInArrow(run, "a bigint, b bigint"), "links")


def components(links: DataFrame) -> DataFrame:
    """id, root for every id in the links ``a, b``: the smallest id reachable.

    Tasks join up the links they hold, ``HELD`` or so each, as long as that leaves work
    for fewer tasks. What is still open ends by alternating stars: first every neighbour above a node is hung
    on the node's smallest neighbour, then the neighbours below it and the node itself
    are. Both keep the components, and the number of links never grows. Rounds end when
    the links are stars: when no node with a smaller neighbour has another one. Links
    are written to the shared folder.
    """
    edges, tasks, large = _spanning(links), math.inf, True
    while (n := max(1, -(-edges.count() // HELD))) < tasks:
        edges, tasks = _spanning(edges.coalesce(n)), n
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = stored(ways.groupBy("a").agg(
            F.min("b").alias("low"), F.max("b").alias("top"),
            F.count_if(F.col("b") < F.col("a")).alias("less")), "nodes")
        if nodes.where("low < a and low <> top").isEmpty():
            return nodes.select(F.col("a").alias("id"), F.least("a", "low").alias("root"))
        if large:
            low = nodes.where("low < a").select(F.col("a").alias("b"), "low")
            edges = edges.join(low, "b", "left").select("a", F.coalesce("low", "b").alias("b"))
        else:
            low = nodes.where("less > 1").select("a", "low")
            edges = edges.join(low, "a", "left").select(
                F.when(F.col("b") != F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"),
                F.coalesce("low", "b").alias("b"))
        edges, large = _spanning(edges), not large
