"""Packing documents into sequences of equal capacity, best fit first.

Documents are cut into pieces no longer than a sequence. Only the number of pieces of each
length matters to the packing, so best-fit decreasing runs over that bounded list: a
segment tree over the remaining capacities finds the tightest open bin of a piece, and
pieces of one length go into bins of one remaining capacity as a run. Each piece then finds
its place by its rank among the pieces of its length, which tasks count on their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlat.llm.support import SLICE_BYTES, broadcast_if_small, slices, written
from streamlat.llm.vocabulary import PIECES as REMEMBERED, encoding

CAPACITY = 4096

PIECES = ("doc_id long, piece int, start long, length int, ids binary, "
          "ids_crc32 long, task int, place long")


class OpenBins:
    """Segment tree over remaining capacities; each leaf says whether such bins are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        at = self.size + room
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest open room of at least `length`."""
        at = self.size + length
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Runs (length, rank, n, each, bin, offset): from `rank` on, `n` pieces of `length`
    go into the bins from `bin` on, `each` to a bin, the first at `offset`.

    The same as placing the pieces one by one: once a piece is in the tightest bin, that
    bin stays the tightest one for the next piece of the same length while it has room.
    """
    tree, rooms, runs, bins = OpenBins(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                # The rest of the pieces, fewer than fit, go into one more bin.
                if left:
                    runs.append((length, rank, left, each, first + full, capacity - room))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    put(room, first + full, n - full)
    return runs


def cut_pieces(docs: DataFrame, vocabulary: str, *, end_id: int, capacity: int,
               remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all documents, with the task and the place among its pieces of that length."""
    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        with encoding(vocabulary, remembered) as encode:
            for rows in slices(batches, size=slice_bytes):
                yield _pieces(rows, encode, seen, task, end_id, capacity)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, PIECES)


def _pieces(rows, encode, seen, task, end_id, capacity) -> pa.RecordBatch:
    ids, counts = encode(rows.column(1))
    ids = np.insert(ids, np.cumsum(counts), np.array(end_id, ids.dtype))
    counts = counts + 1
    n = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(counts[doc] - start, capacity)
    # The place of a piece among those of its length: earlier batches, then this one.
    order = np.argsort(length, kind="stable")
    ranked = length[order]
    first = np.searchsorted(ranked, ranked)
    place = np.empty(len(doc), np.int64)
    place[order] = seen[ranked] + np.arange(len(doc)) - first
    seen += np.bincount(length, minlength=len(seen))
    ends = np.cumsum(length)
    wide = memoryview(ids.astype("<u4").tobytes())
    sums = [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist())]
    offsets = np.concatenate([[0], ends]) * ids.dtype.itemsize
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.tobytes())]
    return pa.RecordBatch.from_arrays(
        [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
         pa.array(length, pa.int32()),
         pa.BinaryArray.from_buffers(pa.binary(), len(doc), buffers),
         pa.array(sums, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(place)],
        names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "place"])


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 1, capacity: int = CAPACITY,
         tokens: str = "ids", remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, `tokens`, sequence_id, offset) of every piece.

    `ids` has the ids as little-endian integers, of 16 bits if the vocabulary allows it and
    of 32 bits otherwise; `ids_crc32` is their checksum as integers of 32 bits. A missing or empty text is its end id alone. Repeated rows are
    packed each time; without documents there are no pieces. A worker remembers the ids of `remembered`
    words and encodes `slice_bytes` of text at a time: less of either takes less memory and more time.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, vocabulary, end_id=end_id, capacity=capacity, remembered=remembered,
                                slice_bytes=slice_bytes), "pieces")
    each = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # Rows: lengths times tasks. The window of a length has one row for each task.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(each.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    # At most one row for each length up to the capacity.
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_decreasing(counts, capacity)
    return _placed(pieces, bases, spark.sparkContext.broadcast(
        np.array(runs, np.int64).reshape(-1, 6)), tokens)


def _placed(pieces: DataFrame, bases: DataFrame, runs, tokens: str) -> DataFrame:
    """Pieces with sequence and offset. `runs` has at most a run for each length and kind of bin."""
    def run(batches):
        table = runs.value
        key = table[:, 0] << 44 | table[:, 1]
        order = np.argsort(key)
        table, key = table[order], key[order]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy()
                            .astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            _, first, _, each, bins, offset = table[at].T
            turn = rank - first
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bins + turn // each), pa.array(offset + turn % each * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = (pieces.join(broadcast_if_small(bases.select("length", "task", "base"), 32),
                          ["length", "task"])
              .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                      tokens, (F.col("base") + F.col("place")).alias("rank")))
    kind = dict(pieces.dtypes)[tokens]
    return ranked.mapInArrow(run, f"doc_id long, piece int, start long, length long, {tokens} {kind}, "
                                  "sequence_id long, offset long")
