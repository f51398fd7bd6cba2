"""Hard negatives: rows of another label whose score with an anchor lies just below that of a positive.

Anchors go in blocks of a bounded size, each against all rows in tiles. A tile's scores come from Strassen's
multiplication in whole numbers. The first pass keeps a heap of the best rows of the anchor's own label, the
second one a heap for each window that a positive's score opens. The heaps of all tasks are put together by
anchor, which gives the same as one heap over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.llm.support import written

SCALE = 256
POSITIVES = 5            # rows of its own label that an anchor gets
NEGATIVES = 3            # rows of another label for each of them
WINDOW = (50, 95, 100)   # 50 * positive <= 100 * negative <= 95 * positive

LEAF = 16                # sides up to this are multiplied directly
ROWS_AT_A_TIME = 4096    # candidates of a tile
ANCHORS_AT_A_TIME = 256  # anchors of a tile
BLOCK_BYTES = 16 << 20   # of the anchors of a block, broadcast

LEAST = np.iinfo(np.int64).min

ENTRY = "anchor int, slot int, score long, id long"
MINED = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
         "negative_score long")


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for int64, by seven products of halves; odd sides get a row or column of zeros.

    Sums and products are exact modulo 2**64, so each number of the result is exact if it fits.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return np.einsum("ij,jk->ik", a, b)  # no library for whole numbers is behind `@`
    a, b = (np.pad(x, [(0, side % 2) for side in x.shape]) if x.shape[0] % 2 or x.shape[1] % 2 else x
            for x in (a, b))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of `n` keys the `size` best (score, id): higher scores first, then smaller ids; no pair twice."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.score = np.full((n, size), LEAST)
        self.id = np.zeros((n, size), np.int64)
        self.count = np.zeros(n, np.int64)

    def push(self, keys: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Add the allowed scores of a row for each key (no key twice) and a column for each id (ascending)."""
        worst = np.where(self.count[keys] < self.size, LEAST, self.score[keys, -1])
        good = allowed & (scores >= worst[:, None])
        # A pair that is there twice would take two places; only merge() sees that.
        same = np.concatenate([[False], ids[1:] == ids[:-1], [False]])
        again = same[1:] | same[:-1]
        if again.any():
            row, column = np.nonzero(good & again)
            self.merge(keys[row], scores[row, column], ids[column])
            good &= ~again
        many = np.flatnonzero(good.sum(1) > self.size)
        if len(many):
            among = np.where(good[many], scores[many], LEAST)
            least = np.partition(among, -self.size, axis=1)[:, -self.size][:, None]
            above, level = among > least, good[many] & (among == least)
            # Of equal ones those with the smallest ids.
            good[many] = above | level & (np.cumsum(level, 1) <= self.size - above.sum(1)[:, None])
        row, column = np.nonzero(good)
        self.merge(keys[row], scores[row, column], ids[column])

    def merge(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Add entries of any keys in any order."""
        if not len(keys):
            return
        touched = np.unique(keys)
        row, slot = np.nonzero(np.arange(self.size) < self.count[touched][:, None])
        old = touched[row]
        keys = np.concatenate([old, keys])
        scores = np.concatenate([self.score[old, slot], scores])
        ids = np.concatenate([self.id[old, slot], ids])
        order = np.lexsort((ids, ~scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        keys, scores, ids = keys[new], scores[new], ids[new]
        place = np.arange(len(keys)) - np.searchsorted(keys, keys)
        kept = place < self.size
        keys, place = keys[kept], place[kept]
        self.score[keys, place], self.id[keys, place] = scores[kept], ids[kept]
        self.count[touched] = np.minimum(np.bincount(np.searchsorted(touched, keys), minlength=len(touched)), self.size)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, place from 0, score and id of all that is held."""
        key, place = np.nonzero(np.arange(self.size) < self.count[:, None])
        return key, place, self.score[key, place], self.id[key, place]


def whole_numbers(vectors: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x, taken as a double."""
    return F.transform(vectors, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(rows: DataFrame, vectors: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and vector of the rows that take part.

    Left out are rows without vec_id, label or vector, those with a missing or not finite component, and
    those whose vector of whole numbers has a squared length of 2**62 or more: no score of two others can
    leave 64 bits. An empty vector is one of zeros.
    """
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    length = F.aggregate(vectors, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0)))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vectors).isNotNull()
                      & F.forall(vectors, real)).where(length < 2.0 ** 62)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       whole_numbers(vectors, scale).alias("vector"))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row for each vector, short ones closed by zeros."""
    sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _tiles(batches: Iterator[pa.RecordBatch], width: int):
    """ids (ascending), labels and a matrix with a column for each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
            part = batch.slice(at, ROWS_AT_A_TIME)
            ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(ids, kind="stable")
            yield ids[order], labels[order], np.ascontiguousarray(_matrix(part.column(2), width)[order].T)


def _entries(heaps: Heaps, slots: int) -> pa.RecordBatch:
    key, _, score, item = heaps.entries()
    return pa.RecordBatch.from_arrays(
        [pa.array((key // slots).astype(np.int32)), pa.array((key % slots).astype(np.int32)), pa.array(score),
         pa.array(item)], names=["anchor", "slot", "score", "id"])


def _merged(entries: DataFrame, n: int, slots: int, size: int, schema: str, made) -> DataFrame:
    """What `made` gives of the heaps that the entries of all tasks make; an anchor's are in one task."""
    def run(batches):
        heaps = Heaps(n * slots, size)
        for batch in batches:
            anchor, slot, score, item = (c.to_numpy() for c in batch.columns)
            heaps.merge(anchor.astype(np.int64) * slots + slot, score, item)
        yield made(heaps)

    return entries.repartition("anchor").mapInArrow(run, schema)


def _positives(rows: DataFrame, block) -> DataFrame:
    """The best rows of each anchor's label, itself excepted."""
    def run(batches):
        ids, labels, vectors = block.value
        heaps = Heaps(len(ids), POSITIVES)
        for item, label, columns in _tiles(batches, vectors.shape[1]):
            for at in range(0, len(ids), ANCHORS_AT_A_TIME):
                part = slice(at, at + ANCHORS_AT_A_TIME)
                allowed = (labels[part, None] == label) & (ids[part, None] != item)
                keys = np.arange(len(ids))[part]
                heaps.push(keys, strassen(vectors[part], columns), allowed, item)
        yield _entries(heaps, 1)

    return _merged(rows.mapInArrow(run, ENTRY), block.size, 1, POSITIVES, ENTRY, lambda h: _entries(h, 1))


def _negatives(rows: DataFrame, block, found) -> DataFrame:
    """The best rows in the window of each positive of each anchor, ranked."""
    low, high, whole = WINDOW

    def run(batches):
        ids, labels, vectors = block.value
        scores, _, there = found.value
        least, most = -(-low * scores // whole), high * scores // whole
        heaps = Heaps(len(ids) * POSITIVES, NEGATIVES)
        for item, label, columns in _tiles(batches, vectors.shape[1]):
            for at in range(0, len(ids), ANCHORS_AT_A_TIME):
                part = slice(at, at + ANCHORS_AT_A_TIME)
                product = strassen(vectors[part], columns)
                other = labels[part, None] != label
                for slot in range(POSITIVES):
                    inside = (other & (product >= least[part, slot, None]) & (product <= most[part, slot, None])
                              & there[part, slot, None])
                    heaps.push(np.arange(len(ids))[part] * POSITIVES + slot, product, inside, item)
        yield _entries(heaps, POSITIVES)

    def named(heaps):
        ids, scores, items = block.value[0], found.value[0], found.value[1]
        key, place, score, item = heaps.entries()
        anchor, slot = key // POSITIVES, key % POSITIVES
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[anchor], items[anchor, slot], (place + 1).astype(np.int32), item,
                                   scores[anchor, slot], score)],
            names=[c.split()[0] for c in MINED.split(", ")])

    return _merged(rows.mapInArrow(run, ENTRY), block.size, POSITIVES, NEGATIVES, MINED, named)


class _Block:
    """A broadcast value and how many anchors it has; tasks get the value alone."""

    def __init__(self, spark, value):
        self.shared, self.size = spark.sparkContext.broadcast(value), len(value[0])

    @property
    def value(self):
        return self.shared.value


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives.

    `rows` has vec_id, label and vector (whole numbers), as `usable` gives them. An anchor's positives are its
    first `POSITIVES` rows of its label with another vec_id; its negatives are for each of them the first
    `NEGATIVES` rows of another label in the window. Higher scores come first, ties by smaller vec_id. Of
    rows with one vec_id and one score one counts; equal anchors are one. Short vectors are closed by zeros.
    Without rows, anchors, positives or negatives nothing comes out. Other columns are not read.

    Anchors pass the driver in blocks of `BLOCK_BYTES`; each block has its own two passes over `rows`, which
    should be a table, and is written when it is done.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "vector")
    anchors = written(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "vector"]), "anchors")
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], MINED)
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0])
    blocks = -(-n * 8 * (width + 2) // BLOCK_BYTES)
    number = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks))
    done = None
    for turn in range(blocks):
        table = anchors.where(number == turn).orderBy("vec_id").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        ids, labels = (table.column(i).to_numpy() for i in (0, 1))
        block = _Block(spark, (ids, labels, _matrix(table.column(2).combine_chunks(), width)))
        scores, items = (np.zeros((len(ids), POSITIVES), np.int64) for _ in range(2))
        there = np.zeros((len(ids), POSITIVES), bool)
        best = Heaps(len(ids), POSITIVES)
        # `POSITIVES` rows an anchor of the block at most.
        kept = _positives(rows, block).toArrow()
        best.merge(*(kept.column(c).to_numpy().astype(np.int64) for c in ("anchor", "score", "id")))
        key, place, score, item = best.entries()
        scores[key, place], items[key, place], there[key, place] = score, item, True
        found = _Block(spark, (scores, items, there))
        part = written(_negatives(rows, block, found), "mined")
        done = part if done is None else done.union(part)
        block.shared.unpersist()
        found.shared.unpersist()
    return done
