"""Exact substring dedup with a column-wise multi-string suffix order.

A byte goes when a string of ``length`` bytes that covers it also starts
somewhere else. The work is cut so that equal strings always meet:

1. Every window of ``length`` bytes is assigned its anchor, the leftmost of its
   ``gram``-byte grams with the least hash. The anchor depends on the window's
   bytes alone, so equal windows have equal anchors at equal places. Consecutive
   windows with one anchor form a segment; a segment whose anchor is met
   nowhere else holds no repeat and goes no further. Segments of equal bytes are
   repeats as a whole; one of them stands for all in the next step.
2. Segments with one anchor are aligned at it and form a collection. Its
   suffix order is built column by column from the right: each round inserts one
   symbol of every segment, stably re-sorts the previous order by that symbol
   (the round's column of the collection's Burrows-Wheeler transform), and
   updates the common prefix of neighbours as one more than the least over the
   old range between them. Equal windows start in one column, so no two
   columns need comparing. A window whose neighbour shares ``length`` bytes is a
   repeat. The sequential external files of the construction are Spark's own:
   segments arrive sorted by anchor from shuffle files, and only one batch of
   whole collections is in memory.
3. An anchor with more than ``hot`` different segments would make a collection
   too large for a task. Its windows take an exact way around step 2: a count of
   128-bit window digests, which combines before it shuffles.

A null text is empty; texts shorter than ``length`` have no window; repeated
rows are repeats of each other. One row per input row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import BASE, U64, byte_values, mix, powers, text_bytes, text_chunks
from fieldcast.llm._ship import shipped
from fieldcast.session import stored

LENGTH, GRAM, HOT = 400, 128, 2048
#: segments ordered together
BATCH = 4096
_ROW = ["doc_id", "_t"]


def _sums(raw: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial in BASE, and the powers that shift it back."""
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(byte_values(seed)[raw] * powers(len(raw)), out=total[1:])
    return total, powers(len(raw) + 1, pow(BASE, -1, 1 << 64))


def _rolled(raw: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each position on."""
    total, back = _sums(raw, seed)
    m = max(len(raw) - n + 1, 0)
    return mix((total[n:n + m] - total[:m]) * back[:m])


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` neighbours."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (span - width)], x[span - width:]) if span > width else x


def anchored(raw: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Segments: start, windows, anchor, anchor's hash and a hash of the segment's
    bytes; positions count from the first byte."""
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, np.empty(0, U64), np.empty(0, U64)
    h = _rolled(raw, gram, 31)
    bits = U64(34)  # 30 of a hash, at every size, then the position
    least = _least((h >> bits) << bits | np.arange(len(h), dtype=U64), length - gram + 1)
    anchor = (least & U64((1 << int(bits)) - 1)).astype(np.int64)
    first = np.arange(len(anchor))
    use = np.flatnonzero(first + length <= np.repeat(at[1:], np.diff(at))[:len(anchor)])
    new = np.ones(len(use), bool)
    new[1:] = (anchor[use[1:]] != anchor[use[:-1]]) | (use[1:] != use[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(use)))
    begin = use[begin]
    total, back = _sums(raw, 47)
    content = mix((total[begin + n + length - 1] - total[begin]) * back[begin])
    content = mix(content + (n * 1024 + anchor[begin] - begin).astype(U64))
    return begin, n, anchor[begin], h[anchor[begin]], content


def order_columns(keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, n: np.ndarray,
                  anchors: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Per segment and window, whether the window's string starts elsewhere too.

    keys: the collection of each segment, rising; starts: of the segments in ``raw``.
    """
    m, left, width = len(keys), length - gram, 2 * length - gram
    grid = np.full((width, m), -1, np.int16)
    column = np.arange(width)[:, None] - left + anchors[None, :]  # place in the segment
    inside = (column >= 0) & (column < (n + length - 1)[None, :])
    at = np.where(inside, starts[None, :] + column, 0)
    grid[inside] = raw[at[inside]]
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) * 257 + 1
    order, common = np.arange(m), np.zeros(m, np.int32)
    hit = np.zeros((m, left + 1), bool)
    for c in range(width - 1, -1, -1):
        symbol = grid[c][order]
        rank = group[order] + symbol
        perm = np.argsort(rank, kind="stable")
        rank, symbol = rank[perm], symbol[perm]
        same = np.flatnonzero((rank[1:] == rank[:-1]) & (symbol[1:] >= 0)) + 1
        a, b = perm[same - 1], perm[same]
        shared = common[b]
        far = np.flatnonzero(b > a + 1)
        if len(far):
            cuts = np.stack([a[far] + 1, b[far] + 1], 1).ravel()
            shared[far] = np.minimum.reduceat(np.append(common, 0), cuts)[::2]
        common = np.zeros(m, np.int32)
        common[same] = shared + 1
        order = order[perm]
        if c <= width - length:
            found = np.flatnonzero(common >= length)
            if len(found):
                who = order[np.concatenate([found, found - 1])]
                window = c - left + anchors[who]
                ok = (window >= 0) & (window < n[who])
                hit[who[ok], window[ok]] = True
    return hit


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and length of each run of true values in a row."""
    wide = np.zeros((len(hit), hit.shape[1] + 2), np.int8)
    wide[:, 1:-1] = hit
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - first


_META = "doc_id bigint, _t bigint, key bigint, content bigint, start int, n int, anchor int"


def _meta(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of all rows."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            raw, at = text_bytes(part.column("text"))
            begin, n, anchor, key, content = anchored(raw, at, length, gram)
            row = np.searchsorted(at, begin, "right") - 1
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("_t").take(take),
                 pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array((begin - at[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                 pa.array((anchor - begin).astype(np.int32))],
                names=["doc_id", "_t", "key", "content", "start", "n", "anchor"])

    return docs.where(F.octet_length("text") >= length).mapInArrow(find, _META)


def _cut(rows: DataFrame) -> DataFrame:
    """The bytes of each segment of the rows' ``segs``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            raw, at = text_bytes(part.column("text"))
            segs = part.column("segs")
            row = np.repeat(np.arange(part.num_rows), segs.value_lengths().to_numpy(False))
            s = segs.flatten()
            start = s.field("start").to_numpy() + at[row]
            size = s.field("size").to_numpy()
            upto = np.concatenate([[0], np.cumsum(size)])
            data = raw[np.arange(upto[-1]) - np.repeat(upto[:-1] - start, size)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("_t").take(take), s.field("key"),
                 s.field("start"), s.field("size"), s.field("anchor"),
                 pa.Array.from_buffers(pa.binary(), len(row), [
                     None, pa.py_buffer(upto.astype(np.int32).tobytes()),
                     pa.py_buffer(data.tobytes())])],
                names=["doc_id", "_t", "key", "start", "size", "anchor", "bytes"])

    return rows.mapInArrow(cut, "doc_id bigint, _t bigint, key bigint, start int, size int, "
                                "anchor int, bytes binary")


def _ordered(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, _t, a, b of the repeated runs in the collections."""
    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        raw, at = text_bytes(t["bytes"].combine_chunks())
        n = t["size"].to_numpy() - (length - 1)
        hit = order_columns(t["key"].to_numpy(), raw, at[:-1], n, t["anchor"].to_numpy(), length, gram)
        row, first, run = _runs(hit)
        a = t["start"].to_numpy()[row] + first
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [t["doc_id"].combine_chunks().take(take), t["_t"].combine_chunks().take(take),
             pa.array(a.astype(np.int32)), pa.array((a + run + length - 1).astype(np.int32))],
            names=["doc_id", "_t", "a", "b"])

    def solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                key = part.column("key").to_numpy()
                # all but the last collection are whole
                edge = int(np.searchsorted(key, key[-1], "left"))
                if rows + edge >= BATCH:
                    if edge:
                        held.append(part.slice(0, edge))
                    if edge or held[-1].column("key")[-1].as_py() != key[-1]:
                        yield solve(held)
                        held, rows, part = [], 0, part.slice(edge)
                held.append(part)
                rows += part.num_rows
        if held:
            yield solve(held)

    return (segments.repartition("key").sortWithinPartitions("key")
            .mapInArrow(solve_all, "doc_id bigint, _t bigint, a int, b int"))


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Digest, row and start of every window of the rows' ``segs``."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, limit=1 << 18):
            raw, at = text_bytes(part.column("text"))
            segs = part.column("segs")
            row = np.repeat(np.arange(part.num_rows), segs.value_lengths().to_numpy(False))
            s = segs.flatten()
            n = s.field("size").to_numpy() - (length - 1)
            row = np.repeat(row, n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                     + np.repeat(s.field("start").to_numpy(), n))
            take, place = pa.array(row), at[row] + start
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("_t").take(take),
                 pa.array(_rolled(raw, length, 41)[place].view(np.int64)),
                 pa.array(_rolled(raw, length, 43)[place].view(np.int64)),
                 pa.array(start.astype(np.int32))],
                names=["doc_id", "_t", "key", "check", "start"])

    return rows.mapInArrow(digest,
                           "doc_id bigint, _t bigint, key bigint, check bigint, start int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Repeated spans (doc_id, _t, a, b) and the texts that may hold some."""
    keyed = shipped(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_t"), "text")
    meta = stored(_meta(keyed, length, gram), "segments")
    place = F.xxhash64("doc_id", "_t", "start")
    kinds = meta.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"),
                                               F.min(place).alias("one"))
    per = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all")) \
        .where("all > 1").drop("all")
    met = stored(meta.join(kinds.join(per, "key"), ["key", "content"]), "met")
    end = F.col("start") + F.col("n") + length - 1
    whole = met.where("copies > 1").select(*_ROW, F.col("start").alias("a"),
                                           end.cast("int").alias("b"))
    lists = met.groupBy(*_ROW).agg(F.collect_set(F.when(
        (F.col("kinds") > 1) & (F.col("one") == place), F.struct(
            "start", (F.col("n") + length - 1).alias("size"), "anchor", "key",
            (F.col("kinds") > hot).alias("hot")))).alias("segs"))
    near = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["_t"] == y["_t"])
    texts = stored(keyed.join(lists.hint("shuffle_hash"), near(keyed, lists)).select(
        keyed["doc_id"], keyed["_t"], "text", "segs"), "texts")
    pick = lambda hot_ones: texts.select(*_ROW, "text", F.filter(
        "segs", lambda s: s["hot"] if hot_ones else ~s["hot"]).alias("segs")).where("size(segs) > 0")
    found = _ordered(_cut(pick(False)), length, gram).unionByName(whole)
    if met.where(F.col("kinds") > hot).limit(1).count():
        windows = stored(_windows(pick(True), length), "windows")
        twice = windows.groupBy("key", "check").count().where("count > 1").select("key", "check")
        found = found.unionByName(windows.join(twice, ["key", "check"]).select(
            *_ROW, F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    return stored(found, "spans"), texts.select(*_ROW, "text")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                 hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans, of every row."""
    spans, texts = repeated_spans(docs, length, gram, hot)
    lists = spans.groupBy(*_ROW).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_t"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("whole"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            raw, at = text_bytes(part.column("text"))
            lists = part.column("spans")
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(False))
            s = lists.flatten()
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, s.field("a").to_numpy() + at[row], 1)
            np.add.at(edge, s.field("b").to_numpy() + at[row], -1)
            gone = np.cumsum(edge[:-1]) > 0
            sums, out = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                g = gone[a:b]
                sums.append(hashlib.sha256(raw[a:b][~g].tobytes()).hexdigest())
                step = np.diff(g.astype(np.int8), prepend=0, append=0)
                out.append([{"a": x, "b": y} for x, y in zip(
                    np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_t"), pa.array(out, pa.list_(pa.struct(
                    [("a", pa.int32()), ("b", pa.int32())]))), pa.array(sums)],
                names=["doc_id", "_t", "removed", "sha"])

    near = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["_t"] == y["_t"])
    cut = texts.join(lists, near(texts, lists)).select(texts["doc_id"], texts["_t"], "text", "spans")
    # equal rows have equal spans
    cut = cut.mapInArrow(remove, "doc_id bigint, _t bigint, removed array<struct<a:int,b:int>>, "
                                 "sha string")
    cut = cut.groupBy(*_ROW).agg(F.any_value("removed").alias("removed"), F.any_value("sha").alias("sha"))
    gone = F.coalesce("removed", F.array().cast("array<struct<a:int,b:int>>"))
    return base.join(cut, near(base, cut), "left").select(
        base["doc_id"], "n_bytes",
        F.aggregate(gone, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("n_removed"),
        F.size(gone).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
        gone.alias("spans"))
