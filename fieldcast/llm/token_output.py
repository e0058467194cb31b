"""Token ids as canonical length-limited Huffman code.

Ids are counted over all documents; package-merge gives the best code lengths of
at most ``limit`` bits, and the canonical code follows from the lengths alone.
Documents are coded one by one, then sorted by doc_id into segments. A segment
is one binary value: a head, its documents' ids and sizes, the bit at which each
block of ``block`` ids starts, and the code. Blocks are decoded independently,
many at once, with one table look-up per id.

Segments are rows of a Parquet table, since only that reaches every store Spark
reaches; their (bucket, number) order is ascending doc_id, so they can be read
as one stream. Beside it lies the table of code lengths.

One row per input row. A null text is empty and so is only its end id; a null
doc_id sorts first; rows that share a doc_id stand side by side, each with its
own start. An empty table gives empty files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm._bytes import text_bytes, text_chunks
from fieldcast.llm._ship import shipped
from fieldcast.llm._tokens import encoder
from fieldcast.llm.packing import with_end
from fieldcast.session import scratch_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
LIMIT, BLOCK, SEGMENT = 18, 1024, 1 << 20
_MAGIC, _HEAD = b"HUF1", struct.Struct("<4sIIQQQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per id, 0 for ids that never occur: package-merge over ``limit`` rows."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = row[:len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        is_leaf.append(at < len(leaves))
    need = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        taken = int(flags[:need].sum())
        lengths[order[:taken]] += 1
        need = 2 * (need - taken)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter first, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def encode(ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, codes: np.ndarray,
           block: int = BLOCK) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """The code of all rows, each from a whole byte on; where each row's bytes
    start (one more at the end); per row, the bit at which its blocks start."""
    n = lengths[ids].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    size = -(-(upto[rows[1:]] - upto[rows[:-1]]) // 8)
    starts = np.concatenate([[0], np.cumsum(size)])
    shift = np.repeat(starts[:-1] * 8 - upto[rows[:-1]], np.diff(rows))
    pos = upto[:-1] + shift
    word, room = pos >> 6, 64 - (pos & 63) - n
    value = codes[ids]
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64),
                    value >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros(int(starts[-1]) // 8 + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        # codes do not overlap, so adding them is joining them
        out[word[first]] = np.add.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    data = out.byteswap().tobytes()[:int(starts[-1])]
    marks = [pos[a:b:block] - s * 8
             for a, b, s in zip(rows[:-1].tolist(), rows[1:].tolist(), starts[:-1].tolist())]
    return data, starts, marks


class Decoder:
    """Look-up table of the next ``limit`` bits."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit = limit
        codes, used = canonical(lengths), np.flatnonzero(lengths)
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.bits = np.zeros(1 << limit, np.int64)
        order = used[np.argsort(codes[used] << (limit - lengths[used]).astype(np.uint64))]
        span = 1 << (limit - lengths[order].astype(np.int64))
        self.symbol[:span.sum()] = np.repeat(order, span)
        self.bits[:span.sum()] = np.repeat(lengths[order], span)

    def blocks(self, data: bytes, bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of the blocks that start at ``bits``, in a row."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        near = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-counts, kind="stable")
        pos, to = bits[order].copy(), (np.cumsum(counts) - counts)[order]
        left = counts[order]
        out = np.zeros(int(counts.sum()), np.uint32)
        down = np.uint32(32 - self.limit)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # blocks with more ids than step
            p = pos[:live]
            look = (near[p >> 3] << (p & 7).astype(np.uint32)) >> down
            out[to[:live] + step] = self.symbol[look]
            pos[:live] += self.bits[look]
        return out


def segment(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, codes: list[bytes],
            marks: list[np.ndarray], first: int, block: int = BLOCK) -> bytes:
    """One binary value for consecutive documents; ``first``: ids before them."""
    at = np.cumsum([0, *map(len, codes)])
    bits = np.concatenate([m + 8 * s for m, s in zip(marks, at.tolist())]) if marks else at[:0]
    return b"".join([_HEAD.pack(_MAGIC, block, len(doc_ids), first, len(bits), int(at[-1])),
                     doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(),
                     sizes.astype("<i8").tobytes(), bits.astype("<i8").tobytes(), *codes])


def read_segment(blob: bytes, decoder: Decoder):
    """doc ids, whether they are known (not null), sizes, ids before the segment, ids."""
    magic, block, n, first, n_blocks, size = _HEAD.unpack_from(blob)
    if magic != _MAGIC:
        raise ValueError("not a segment")
    at = _HEAD.size
    doc_ids = np.frombuffer(blob, "<i8", n, at)
    known = np.frombuffer(blob, "u1", n, at + 8 * n).astype(bool)
    sizes = np.frombuffer(blob, "<i8", n, at + 9 * n)
    bits = np.frombuffer(blob, "<i8", n_blocks, at + 17 * n)
    data = blob[at + 17 * n + 8 * n_blocks:]
    if len(data) != size:
        raise ValueError("segment is cut off")
    many = -(-sizes // block)
    no = np.arange(n_blocks) - np.repeat(np.cumsum(many) - many, many)
    counts = np.minimum(block, np.repeat(sizes, many) - no * block)
    return doc_ids, known, sizes, first, decoder.blocks(data, bits, counts)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """doc_id, n and ids (two or four bytes each) of each document, written to ``path``."""
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        width = int(kind[-1])
        for part in text_chunks(batches):
            flat, rows = with_end(*enc.encode(part.column("text")), end_id)
            data = pa.py_buffer(flat.astype(kind).tobytes())
            ends = pa.py_buffer((rows * width).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(rows)),
                 pa.array(np.full(len(rows) - 1, width, np.int32)),
                 pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, ends, data])],
                names=["doc_id", "n", "width", "ids"])

    kind = "doc_id bigint, n bigint, width int, ids binary"
    rows = shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(ids, kind)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(kind).parquet(path)


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_bytes(part.column("ids"))
    width = int(part.column("width")[0].as_py())
    return np.frombuffer(raw.tobytes(), f"<u{width}").astype(np.int64), at // width


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; a vocabulary is small and fixed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in text_chunks(batches, "ids"):
            c = np.bincount(_flat(part)[0], minlength=len(total))
            c[:len(total)] += total
            total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "c"])

    rows = (tokens.select("width", "ids").mapInArrow(count, "id bigint, c bigint")
            .groupBy("id").agg(F.sum("c").alias("c")).toArrow())
    out = np.zeros((max(rows["id"].to_pylist(), default=-1) + 1), np.int64)
    out[rows["id"].to_numpy()] = rows["c"].to_numpy()
    return out


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
          limit: int = LIMIT, block: int = BLOCK, buckets: int | None = None) -> None:
    """Writes ``path/segments`` and ``path/lengths``."""
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer, end_id, scratch_path(spark, "tokens"))
    lengths = code_lengths(id_counts(tokens), limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used), "bits": pa.array(
        lengths[used].astype(np.int64))}), "id bigint, bits bigint").write.parquet(f"{path}/lengths")
    # ranges of doc_id with about as many documents each
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = tokens.select(F.percentile_approx(
        "doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    cut = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(cut, lambda c: c <= F.col("doc_id")))
    bucket = F.coalesce(F.when(F.col("doc_id").isNotNull(), bucket), F.lit(0)).alias("bucket")
    before, total = {}, 0
    for r in sorted(tokens.groupBy(bucket).agg(F.sum("n").alias("n")).collect()):
        before[r["bucket"]], total = total, total + r["n"]
    sent = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes = sent.value
        for part in text_chunks(batches, "ids"):
            data, at, marks = encode(*_flat(part), bits, codes, block)
            m = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("bucket"), part.column("doc_id"), part.column("n"),
                 pa.Array.from_buffers(pa.binary(), part.num_rows, [
                     None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)]),
                 pa.ListArray.from_arrays(pa.array(m), pa.array(np.concatenate(marks)))],
                names=["bucket", "doc_id", "n", "code", "marks"])

    coded = tokens.select(bucket, "doc_id", "n", "width", "ids").mapInArrow(
        code, "bucket int, doc_id bigint, n bigint, code binary, marks array<bigint>")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = {}, 0
        for part in text_chunks(batches, "code"):
            number += 1
            b = part.column("bucket")[0].as_py()  # repartitionById: one bucket a task
            first = at.get(b, before[b])
            known = np.array([x is not None for x in part.column("doc_id").to_pylist()])
            sizes = part.column("n").to_numpy()
            blob = segment(part.column("doc_id").fill_null(0).to_numpy(), known, sizes,
                           part.column("code").to_pylist(),
                           [np.array(m) for m in part.column("marks").to_pylist()], first, block)
            at[b] = first + int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([blob], pa.binary())], names=["bucket", "number", "segment"])

    (coded.repartitionById(len(cuts) + 1, F.col("bucket"))
     .sortWithinPartitions("doc_id").mapInArrow(join, "bucket int, number int, segment binary")
     .write.option("compression", "uncompressed").parquet(f"{path}/segments"))


def read(spark: SparkSession, path: str, limit: int = LIMIT,
         with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in the files."""
    rows = spark.read.schema("id bigint, bits bigint").parquet(f"{path}/lengths").toArrow()
    lengths = np.zeros(max(rows["id"].to_pylist(), default=-1) + 1, np.uint8)
    lengths[rows["id"].to_numpy()] = rows["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(lengths)
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value, limit)
        for batch in batches:
            for blob in batch.column("segment"):
                doc_ids, known, sizes, first, ids = read_segment(blob.as_py(), decoder)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n):4 * e])
                       for n, e in zip(sizes.tolist(), ends.tolist())]
                out = [pa.array(doc_ids, mask=~known), pa.array(first + ends - sizes),
                       pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    at = np.concatenate([[0], ends]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    segments = shipped(spark.read.schema("bucket int, number int, segment binary")
                       .parquet(f"{path}/segments"))
    return segments.select("segment").mapInArrow(decode, kind + ", ids array<bigint>" * with_ids)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the files and reads them back."""
    path = scratch_path(docs.sparkSession, "huffman")
    write(docs, path, **options)
    return read(docs.sparkSession, path)
