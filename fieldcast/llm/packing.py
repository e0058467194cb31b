"""Best-fit packing by hierarchical residuals.

Documents become token ids with an end id and only those longer than a sequence
are cut. Every partition packs its own pieces, longest first, each into the
fullest bin that still takes it. Bins that are nearly full are final; the
underfull ones become items, those of ``fan`` partitions meet in one task and
are packed again, and so on until one group is left. A task takes about ``carry``
bins; more are dealt to more tasks, round after round, so no task grows with the
input and no bin is closed before it met others.

One row per piece, every piece packed. A null text is empty and so is only its
end id. Rows that share a doc_id are packed each for itself. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm._bytes import text_chunks
from fieldcast.llm._ship import shipped
from fieldcast.llm._tokens import encoder
from fieldcast.session import stored

SIZE, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
FAN, CARRY = 8, 1 << 15
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each row."""
    out = np.insert(ids, rows[1:], end_id).astype("<u4")
    return out, rows + np.arange(len(rows))


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE,
           end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in text_chunks(batches):
            ids, at = with_end(*enc.encode(part.column("text")), end_id)
            n = np.diff(at)
            many = -(-n // size)
            row = np.repeat(np.arange(len(n)), many)
            no = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = no * size
            length = np.minimum(size, n[row] - start)
            raw = memoryview(ids).cast("B")
            a = (at[row] + start) * 4
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(no, pa.int32()),
                 pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: longest item first, each
    into the fullest bin with room."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, size - room
        fills[b] += need
        left = room - need
        if left:
            if not open_bins[left]:
                rooms |= 1 << left
            open_bins[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _level(rows: DataFrame, size: int, slack: int, level: int) -> DataFrame:
    """Packs the items of each partition: item columns with bin, shift, fill, open."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets, fills = best_fit(table["length"].to_numpy(), size)
        done = fills >= size - slack
        first = ((level << 24) + TaskContext.get().partitionId()) << 33
        table = (table.append_column("bin", pa.array(bins + first))
                 .append_column("shift", pa.array(offsets))
                 .append_column("fill", pa.array(fills[bins]))
                 .append_column("open", pa.array(~done[bins])))
        yield from table.to_batches(max_chunksize=100_000)

    zero = F.lit(0).cast("long")
    return rows.mapInArrow(pack, rows.select("*", zero.alias("bin"), zero.alias("shift"),
                                             zero.alias("fill"), F.lit(True).alias("open")).schema)


def packed(items: DataFrame, size: int = SIZE, slack: int | None = None, fan: int = FAN,
           carry: int = CARRY) -> DataFrame:
    """``items`` (column ``length``, at most ``size``) with sequence_id and offset.

    A task takes about ``carry`` underfull bins at most: where more are left, they
    are dealt to more tasks in place of being closed, and dealt anew in the next
    round. Rounds end with one task, or when dealing anew no longer joins bins;
    in each last group one bin at most is then half empty or more.
    """
    slack = size // 128 if slack is None else slack
    shipped(items)
    placed = stored(_level(items, size, slack, 0), "packed")
    # where each open bin goes: bin -> (sequence, shift), a chain of levels
    moves = placed.where("open").groupBy("bin").agg(F.max("fill").alias("length"))
    moves = stored(moves.select(F.col("bin").alias("own"), "length"), "open-bins")
    # the partition that made a bin is in its number
    high = moves.agg(F.max(F.shiftright("own", 33))).first()[0]
    chains, level, before = [], 1, math.inf
    groups = 0 if high is None else int(high) + 1
    while groups > 1:
        left = moves.count()
        wanted = max(-(-groups // fan), -(-left // carry))
        if wanted >= groups and left > 0.98 * before:
            break
        groups, before = wanted, left
        dealt = moves.withColumn("part", F.pmod(F.xxhash64("own", F.lit(level)), F.lit(groups)).cast("int"))
        met = stored(_level(dealt.repartitionById(groups, F.col("part")), size, slack, level), "packed")
        chains.append(met.select(F.col("own"), F.col("bin").alias("up"),
                                 F.col("shift").alias("by")))
        moves = (met.where("open").groupBy("bin").agg(F.max("fill").alias("length"))
                 .select(F.col("bin").alias("own"), "length"))
        level += 1
    out = placed.select(*items.columns, F.col("bin").alias("sequence_id"),
                        F.col("shift").alias("offset"))
    for c in chains:
        out = (out.join(c, out["sequence_id"] == c["own"], "left")
               .withColumns({"offset": F.col("offset") + F.coalesce("by", F.lit(0)),
                             "sequence_id": F.coalesce("up", "sequence_id")})
               .drop("own", "up", "by"))
    return out


def packed_documents(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE,
                     end_id: int = END_ID, **options) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    return packed(stored(pieces(docs, tokenizer, size, end_id), "pieces"), size, **options)
