"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact links.

Documents with equal shingle sets are one node. Nodes that share a band of their MinHash
signatures are candidates. A pair of candidates is compared batch by batch of signature
positions and dropped once the posterior chance that it is similar enough falls below the
miss probability; survivors are confirmed on their full sets. Links join nodes to components.

Large buckets never give all their pairs. First each node is held against the smallest node
of each of its buckets; what is joined by then needs no further pair. In buckets that are
still mixed the full sets decide which pairs are left: the shingles of all their nodes are put
in one order, rare ones first, and the first shingle that two similar sets have in common is
near the front of both. No pair that may be similar is left out.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlat.llm.support import (BROADCAST_BYTES, WordHashes, broadcast_if_small, hashed, map_texts, marked, mixed,
                                   runs, written)

WIDTH = 5             # words of a shingle
SIMILAR = (75, 100)   # links: 100 * intersection >= 75 * union
ROWS, BANDS = 4, 40   # a pair of similarity 0.75 misses all bands with a chance of 3e-7
COMPARED = 32         # signature positions of a step of verification
MISS = 1e-6           # chance to drop a similar pair in verification
SLOTS = 18            # bits of a shingle's hash by which its frequency is counted
SIGNED_BYTES = 2 * ROWS * BANDS + 64  # of a pair with one signature
EDGES = 500_000       # edges that a task takes at least, whatever the shuffle width
BLOCK = 512           # nodes that a task holds against all others of a group

SKETCH = "doc_id long, row long, n_shingles long, digest binary, signature binary, bands array<long>"

_random = np.random.default_rng(20240917)
_FACTORS = _random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingle_sets(texts: list[str], hashes: WordHashes) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles."""
    out = []
    for text in texts:
        words = text.encode().lower().split()
        if not words:
            out.append(np.zeros(0, np.uint64))
        else:
            out.append(np.unique(runs(hashed(words, hashes), min(WIDTH, len(words)))))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum of each hash function over each set; sets must not be empty."""
    out = np.empty((len(sets), ROWS * BANDS), np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    part = (np.cumsum(sizes) - sizes) >> 15
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sets)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            items = np.concatenate(sets[a:b])
            starts = np.cumsum(sizes[a:b]) - sizes[a:b]
            for k in range(ROWS * BANDS):
                out[a:b, k] = np.minimum.reduceat(items * _FACTORS[k] + _SHIFTS[k], starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, row::ROWS])
    return keys.view(np.int64)


def digest_of(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """Size, digest, signature and bands of each document's set; those without words have no bands."""
    def make():
        from pyspark import TaskContext

        hashes, at = WordHashes(), [TaskContext.get().partitionId() << 40]

        def step(batch, texts):
            sets = shingle_sets(texts, hashes)
            full = np.array([len(s) > 0 for s in sets])
            signs = signatures([s for s in sets if len(s)])
            short = (mixed(signs) >> np.uint64(48)).astype("<u2")
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            signed = iter(short)
            row = at[0] + np.arange(len(texts))
            at[0] += len(texts)
            return {"doc_id": batch.column(0), "row": row, "n_shingles": [len(s) for s in sets],
                    "digest": [digest_of(s) for s in sets],
                    "signature": [next(signed).tobytes() if f else None for f in full],
                    "bands": pa.ListArray.from_arrays(offsets, band_keys(signs).ravel())}
        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SKETCH, make)


def least_matches(steps: int, similar: float, miss: float) -> list[int]:
    """For each number of steps done: fewer equal positions than this, and the pair is dropped.

    With a uniform prior, the posterior chance of a similarity of at least s after m of n
    equal positions is that of at most m successes in n + 1 trials of chance s.
    """
    least = []
    for step in range(1, steps + 1):
        n, total, m = step * COMPARED, 0.0, -1
        while total < miss and m < n:
            m += 1
            total += comb(n + 1, m) * similar ** m * (1 - similar) ** (n + 1 - m)
        least.append(m)
    return least


def _plausible(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) that the comparison of signatures does not rule out."""
    def run(batches):
        steps = ROWS * BANDS // COMPARED
        least = least_matches(steps, SIMILAR[0] / SIMILAR[1], MISS)
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2")
                    .reshape(batch.num_rows, -1) for i in (2, 3))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for step in range(steps):
                part = slice(step * COMPARED, (step + 1) * COMPARED)
                equal[alive] += (a[alive, part] == b[alive, part]).sum(1)
                alive = alive[equal[alive] >= least[step]]
            yield batch.select([0, 1]).take(pa.array(alive))

    one = signed.toDF("a", "sign_a").join(broadcast_if_small(pairs, 32), "a")
    if pairs.count() * SIGNED_BYTES <= BROADCAST_BYTES:
        one = F.broadcast(one)
    both = signed.toDF("b", "sign_b").join(one, "b").select("a", "b", "sign_a", "sign_b")
    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, items): the full sets of the documents named in `ids`."""
    def make():
        hashes = WordHashes()

        def step(batch, texts):
            return {"node": batch.column(0), "items": [s.tobytes() for s in shingle_sets(texts, hashes)]}
        return step

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        broadcast_if_small(ids.withColumnRenamed("node", "doc_id"), 16), "doc_id", "left_semi")
    return map_texts(named, "node long, items binary", make).distinct()


def verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) that are links, written.

    `signed` has the signature of each node, `sets` the full sets of all nodes in question if they are there.
    """
    def run(batches):
        least, most = SIMILAR
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(a, b)):
                same = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64),
                                          assume_unique=True))
                keep[i] = most * same >= least * ((len(x) + len(y)) // 8 - same)
            yield batch.select([0, 1]).filter(pa.array(keep))

    likely = written(_plausible(written(pairs, "pairs"), signed), "likely")
    if likely.isEmpty():
        return likely
    if sets is None:
        sets = written(_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    both = (sets.toDF("a", "items_a").join(broadcast_if_small(likely, 32), "a")
            .join(sets.toDF("b", "items_b"), "b").select("a", "b", "items_a", "items_b"))
    return written(both.mapInArrow(run, "a long, b long"), "links")


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Alternates two steps that move edges towards the smallest neighbour, until none moves.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                    .where("u < v").distinct(), "edges")
    before = None
    while before != (now := edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))
                     .first()):
        before = now
        # No node more than there are edges, twice; the joins move no edge if that is little.
        near = F.broadcast if 2 * now[0] * 32 <= BROADCAST_BYTES else lambda df: df
        tasks = 1 + 2 * now[0] // EDGES
        both = edges.union(edges.select("u", "v"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(
            "v", F.least("v", "m").alias("m")).coalesce(tasks)
        large = both.join(near(least), "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m")).coalesce(tasks)
        small = (large.join(near(least), "v").select(F.col("u").alias("v"), "m").where("v <> m")
                 .union(least).distinct().coalesce(tasks).toDF("v", "u"))
        edges = written(small, "edges")
    return edges.toDF("node", "component")


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    found = components.toDF("node", "found")
    return (members.join(broadcast_if_small(found, 32), "node", "left")
            .withColumn("c", F.coalesce("found", "node")).drop("found"))


def _undecided(members: DataFrame, components: DataFrame) -> DataFrame:
    """The nodes of buckets with several components, written."""
    labelled = _labelled(members, components)
    keys = written(labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"))
                   .where("low < high").select("key"), "keys")
    return written(labelled.join(broadcast_if_small(keys, 16), "key", "left_semi").select("node").distinct(), "mixed")


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of buckets with several components: with `major`, the largest, and `few`, how many are outside."""
    labelled = _labelled(members, components)
    each = labelled.groupBy("key", "c").agg(F.count("*").alias("n"))
    kinds = (each.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"),
                                     F.max_by("c", "n").alias("major"))
             .where("all > most").select("key", "major", F.expr("all - most").alias("few")))
    return labelled.join(kinds, "key")


def _across(members: DataFrame, fits: str = "true") -> DataFrame:
    """Pairs of the nodes outside the largest component of a group with all others of it.

    Groups with many such nodes go in blocks, so that no task has all pairs of one. In `fits`,
    the columns of the outside node end in _x.
    """
    blocks = F.ceil(F.col("few") / BLOCK).cast("int")
    outside = members.where("c <> major").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    outside = outside.select("key", "block", *[F.col(k).alias(f"{k}_x") for k in members.columns if k != "key"])
    others = members.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return (outside.join(others, ["key", "block"]).where(f"c <> c_x AND (c = major OR node_x < node) AND {fits}")
            .select(F.least("node_x", "node").alias("a"), F.greatest("node_x", "node").alias("b")).distinct())


def _slots(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SLOTS)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall in each slot: a fixed number, whatever the size of the sets."""
    def run(batches):
        counts = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for items in batch.column(0).to_pylist():
                np.add.at(counts, _slots(np.frombuffer(items, np.uint64)), 1)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])

    counts = np.zeros(1 << SLOTS, np.int64)
    # A row a slot at most.
    for slot, n in (sets.select("items").mapInArrow(run, "slot long, n long").groupBy("slot")
                    .agg(F.sum("n")).collect()):
        counts[slot] = n
    return counts


def fronts(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of their frequency: what a similar set must share one of."""
    least, most = SIMILAR
    order = items[np.lexsort((items, counts[_slots(items)]))]
    return order[:len(items) - -(-least * len(items) // most) + 1]


# Two sets whose first common shingle has `left` shingles from there on, itself among them, share
# at most the lesser `left`.
FITS = f"{sum(SIMILAR)} * least(left, left_x) >= {SIMILAR[0]} * (n + n_x)"


def _fronts(sets: DataFrame) -> DataFrame:
    """(key, node, n, left): the fronts of the sets, as groups by shingle."""
    counts = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                front = [fronts(x, counts.value) for x in sets]
                sizes = np.fromiter(map(len, front), np.int64, len(front))
                n = np.repeat(np.fromiter(map(len, sets), np.int64, len(sets)), sizes)
                turn = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(front).view(np.int64)),
                     pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)),
                     pa.array(n.astype(np.int32)), pa.array((n - turn).astype(np.int32))],
                    names=["key", "node", "n", "left"])

    return sets.select("node", "items").mapInArrow(run, "key long, node long, n int, left int")


def _left_over(sets: DataFrame, components: DataFrame) -> DataFrame:
    """All pairs of the nodes that may be similar and are not in one component, by their full sets."""
    fronts_ = _labelled(written(_fronts(sets), "fronts"), components)
    least, most = SIMILAR
    # The smaller set of a pair shares at least this much of itself.
    near = F.max(F.col("left") * (least + most) >= 2 * least * F.col("n"))
    groups = (fronts_.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), near.alias("near"))
              .where("low < high AND near").select("key"))
    mixed = written(_mixed(fronts_.drop("c").join(groups, "key"), components), "members")
    return _across(mixed, FITS)


def _shared(bands: DataFrame) -> DataFrame:
    """Members of buckets with two nodes or more, with the smallest of each bucket."""
    buckets = written(bands.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"))
                      .where("center < last").select("key", "center"), "buckets")
    return bands.join(broadcast_if_small(buckets, 24), "key").select("key", "node", "center")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs`.

    A component is named by its smallest doc_id; `kept` is true for that one, so one document
    of each component stays. Documents without text or words have no set and are linked with
    nothing. Repeated rows come out each time and are in one component. Rows that share a
    doc_id but not the text are compared each with its own text, and are put together where
    they stand for their sets. Rows without doc_id are kept, with a NULL component, and link
    nothing. Other columns are not read.
    """
    return _rated(docs).drop("digest")


def _rated(docs: DataFrame) -> DataFrame:
    """What `components` gives, with the digest of each row's set."""
    sketches = written(sketch(docs), "sketch")
    classes = written(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n"))
        .select("digest", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row"), "n"),
        "classes")
    nodes = sketches.join(broadcast_if_small(classes.select("row", "node"), 32), "row")
    signed = nodes.select("node", "signature")
    shared = written(_shared(nodes.select("node", F.explode("bands").alias("key"))), "shared")
    named = docs.where("doc_id IS NOT NULL")

    stars = shared.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(stars, signed, named)
    found = connected(links)
    ids = _undecided(shared.select("key", "node"), found)
    if not ids.isEmpty():
        sets = written(_sets(named, ids), "sets")
        more = verified(_left_over(sets, found), signed, named, sets)
        if not more.isEmpty():
            found = connected(more.union(found.toDF("a", "b")))

    named_classes = (classes.join(broadcast_if_small(found, 32), "node", "left")
                     .where("n > 1 OR component IS NOT NULL")
                     .select("digest", F.coalesce("component", "node").alias("component")))
    labelled = sketches.select("doc_id", "n_shingles", "digest").join(
        broadcast_if_small(named_classes, 48), "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(
        F.coalesce("component", "doc_id")).cast("long")
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"),
                           F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "digest")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without the documents that a smaller doc_id stands for.

    Of rows with one doc_id and equal sets one stays; those with other sets are judged by themselves.
    """
    def make():
        hashes = WordHashes()

        def step(batch, texts):
            return {"digest": [digest_of(s) for s in shingle_sets(texts, hashes)]}
        return step

    labels = written(_rated(docs).where("doc_id IS NOT NULL").select("doc_id", "digest", "kept"), "labels")
    again = written(labels.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
                    .select(F.col("doc_id").alias("again")), "again")
    known = broadcast_if_small(again, 16)
    gone = written(labels.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    gone = broadcast_if_small(gone, 16)
    single = (docs.join(known, docs["doc_id"] == known["again"], "left_anti")
              .join(gone, docs["doc_id"] == gone["gone"], "left_anti"))
    several = marked(docs.join(known, docs["doc_id"] == known["again"], "left_semi"), "digest binary", make)
    kept = labels.where("kept").join(known, labels["doc_id"] == known["again"], "left_semi").select("doc_id", "digest")
    return single.union(several.withColumn("doc_id", F.col("row.doc_id")).join(kept, ["doc_id", "digest"], "left_semi")
                        .dropDuplicates(["doc_id", "digest"]).select("row.*"))
