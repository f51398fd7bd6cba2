"""Benchmark passages in documents, found with suffix arrays over shards of the documents.

A shard is a run of documents. Its suffix array holds the positions from which on enough
words of the benchmark's vocabulary follow each other; no other position can begin a match.
Every suffix of every benchmark item is looked up in it by binary search, which gives all
places of the item's windows and, by the neighbours in the order, the longest verbatim
match. Benchmarks are broadcast in blocks of bounded size, one after another.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlat.llm.support import marked, text_slices, written

WINDOW = 10              # words of a window
BLOCK_BYTES = 8 << 20    # benchmark text of a block

# ASCII capitals become small letters; what is no word character becomes a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127
                 else 32 for b in range(256))

MARKS = ("n_words long, spans array<struct<start:long,end:long>>, items array<string>, "
         "longest long, longest_at long")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


class Block:
    """Items of a benchmark as numbers: a vocabulary, and the suffixes that begin a window."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        ids, suffix, room, width, item = [], [], [], [], []
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            need = min(window, len(found))
            for at in range(len(found) - need + 1 if found else 0):
                suffix.append(len(ids) + at)
                room.append(len(found) - at)
                width.append(need)
                item.append(k)
            ids += [*found, 0]
        self.ids = np.array(ids or [0], np.int64)
        # Where each item begins; the 0 after it is its last.
        self.starts = np.concatenate([[0], np.flatnonzero(self.ids == 0) + 1])
        self.suffix, self.room, self.width, self.item = (
            np.array(x, np.int64) for x in (suffix, room, width, item))
        self.shortest = int(self.width.min()) if suffix else 0
        self.deepest = int(self.room.max()) if suffix else 0


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the first `depth` ids from there on, by doubling."""
    _, rank = np.unique(ids, return_inverse=True)
    step = 1
    while step < depth and len(rank) and rank.max() < len(rank) - 1:
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def common(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray,
           most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of a[at:] and b[bt:], up to `most`."""
    length, alive = np.zeros(len(at), np.int64), np.flatnonzero(most > 0)
    while len(alive):
        x, y = at[alive] + length[alive], bt[alive] + length[alive]
        same = (x < len(a)) & (y < len(b))
        same[same] = a[x[same]] == b[y[same]]
        alive = alive[same]
        length[alive] += 1
        alive = alive[length[alive] < most[alive]]
    return length


def search(queries: np.ndarray, at: np.ndarray, most: np.ndarray, ids: np.ndarray,
           order: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each queries[at:at + most] among the suffixes of `ids`.

    The first place whose suffix is not before the query, or with `after` the first whose
    suffix is past all that begin with it.
    """
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        place, query = order[middle], at[open_]
        n = common(queries, query, ids, place, most[open_])
        full = n == most[open_]
        theirs = ids[np.minimum(place + n, len(ids) - 1)]
        ends = place + n >= len(ids)
        ours = queries[np.minimum(query + n, len(queries) - 1)]
        up = np.where(full, after, ends | (theirs < ours))
        low[open_] = np.where(up, middle + 1, low[open_])
        high[open_] = np.where(up, high[open_], middle)
    return low


def candidates(shard: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least `shortest` known words, each closed by 0, and their places in the shard."""
    known = np.concatenate([[0], (shard > 0).view(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    keep = end - begin >= shortest
    begin, end = begin[keep], end[keep]
    sizes = end - begin + 1
    last = np.cumsum(sizes)
    place = np.arange(last[-1] if len(last) else 0) + np.repeat(begin - (last - sizes), sizes)
    ids = shard[np.minimum(place, len(shard) - 1)] if len(place) else np.zeros(0, np.int64)
    ids[last - 1] = 0
    return ids, place


def look_up(block: Block, texts: list[str]) -> list[tuple[int, list, list, int, int]]:
    """For each text: words, spans of hit words, items found, longest match and where it begins."""
    get = block.vocabulary.get
    found = [words(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    # A 0 after each document keeps matches inside it.
    bounds = np.cumsum(counts + 1)
    starts = bounds - counts - 1
    shard = np.fromiter((i for w in found for i in (*map(get, w, repeat(0)), 0)), np.int64,
                        int(bounds[-1]))
    out = [(n, [], [], 0, -1) for n in counts.tolist()]
    if not block.shortest:
        return out
    ids, place = candidates(shard, block.shortest)
    if not len(ids):
        return out
    doc = np.searchsorted(bounds, place, side="right")
    order = suffix_array(ids, block.deepest)
    low = search(block.ids, block.suffix, block.width, ids, order, after=False)
    high = search(block.ids, block.suffix, block.width, ids, order, after=True)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return out
    # Suffixes that begin with the same window have the same range.
    ranges, which = np.unique(np.stack([low[hit], high[hit], block.width[hit]]), axis=1,
                              return_inverse=True)
    which = which.ravel()
    edge = np.zeros(len(ids) + 1, np.int64)
    pairs, short = [], [np.zeros((2, 0), np.int64)]
    by_range = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[by_range], np.arange(ranges.shape[1] + 1))
    for k in range(ranges.shape[1]):
        at = order[ranges[0, k]:ranges[1, k]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + ranges[2, k], -1)
        if ranges[2, k] < block.window:
            short.append(np.stack([at, np.full(len(at), ranges[2, k])]))
        items = np.unique(block.item[hit[by_range[cuts[k]:cuts[k + 1]]]])
        docs = np.unique(doc[at])
        pairs.append(np.unique(np.repeat(docs, len(items)) * len(block.names)
                               + np.tile(items, len(docs))))
    covered = np.cumsum(edge[:-1]) > 0
    places = place[covered]
    step = np.flatnonzero(np.diff(places) != 1) + 1
    first, last = places[np.concatenate([[0], step])], places[np.concatenate([step - 1, [-1]])]
    spans: dict[int, list] = {}
    for a, b, d in zip(first.tolist(), last.tolist(),
                       np.searchsorted(bounds, first, side="right").tolist()):
        spans.setdefault(d, []).append((a - int(starts[d]), b + 1 - int(starts[d])))
    items = {}
    for pair in np.unique(np.concatenate(pairs)).tolist():
        d, k = divmod(pair, len(block.names))
        items.setdefault(d, set()).add(block.names[k])
    whole = np.unique(block.item[hit[block.width[hit] == block.window]])
    for d, (best, at) in _longest(block, whole, ids, doc, covered, np.concatenate(short, axis=1)).items():
        out[d] = (out[d][0], spans[d], sorted(items[d] - {None}), best, int(place[at] - starts[d]))
    return out


def ranks(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """At k, numbers of equal and in the order of the 2**k ids from each position on, up to `depth` or all different."""
    _, rank = np.unique(ids, return_inverse=True)
    out = [rank]
    while 1 << len(out) - 1 < depth and rank.max() < len(rank) - 1:
        step = 1 << len(out) - 1
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)
        out.append(rank)
    return out


def prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at `a` and at `b`, by steps of falling powers of two."""
    size, length = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        same = np.maximum(x, y) + (1 << k) <= size
        same[same] = levels[k][x[same]] == levels[k][y[same]]
        length += same.astype(np.int64) << k
    return length


def _longest(block: Block, found: np.ndarray, ids, doc, covered, short) -> dict[int, tuple[int, int]]:
    """For each document its longest match of a window or more, and its place in `ids`.

    The covered words and the items `found` are put in one order; the nearest item suffix before or after
    a position has its longest match. Equal words cost n log n like any others. `short` are
    the places and lengths of items of less than a window, which match as a whole.
    """
    at = np.flatnonzero(covered)
    # Each stretch of covered words is closed, so that no match goes on into the next.
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    own, place = np.insert(ids[at], cuts, 0), np.insert(at, cuts, -1)
    parts = [block.ids[a:b] for a, b in zip(block.starts[found].tolist(), block.starts[found + 1].tolist())]
    joint = np.concatenate([own, [0], *parts])
    ends = np.flatnonzero(joint == 0)
    joint[ends] = -1 - np.arange(len(ends))
    levels = ranks(joint, min(block.deepest, len(at)))
    order = np.lexsort((np.arange(len(joint)), levels[-1]))
    item = order > len(own)
    # The nearest item suffix on either side of each position in the order.
    rank = np.arange(len(order))
    before = np.maximum.accumulate(np.where(item, rank, -1))
    after = np.minimum.accumulate(np.where(item, rank, len(order))[::-1])[::-1]
    where = np.flatnonzero((order < len(own)) & (joint[order] > 0))
    here, best = order[where], np.zeros(len(where), np.int64)
    for side in (before[where], after[where]):
        there = (side >= 0) & (side < len(order))
        best[there] = np.maximum(best[there], prefixes(levels, here[there], order[side[there]]))
    best[best < block.window] = 0
    at, best = np.concatenate([place[here], short[0]]), np.concatenate([best, short[1]])
    rows = np.lexsort((at, -best, doc[at]))
    first = np.unique(doc[at[rows]], return_index=True)
    return {d: (int(best[rows[i]]), int(at[rows[i]])) for d, i in zip(first[0].tolist(), first[1].tolist())}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Items with a text, dealt into blocks of about `block_bytes` at most."""
    named = items.where("text IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item_id"), "text")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def find_items(docs: DataFrame, items: DataFrame, *, window: int = WINDOW,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`row`, with all columns of each document, and what of the items is in it.

    n_words; spans, the hit words from start to before end; items, the ids of items with a
    window in the document, sorted; longest and longest_at, the longest verbatim match in
    words, at least a window, and its first word (-1 without). A missing text has no words. Items without text or
    words are in no document; those without id count for spans and the longest match, but are
    not in `items`. An item id that comes twice counts once. Repeated rows are marked each time.
    """
    spark = docs.sparkSession
    out = None
    parts = blocks(items, block_bytes)
    for part in parts:
        # Bounded by the size of a block.
        block = spark.sparkContext.broadcast(
            Block([(r.item_id, r.text) for r in part.distinct().collect()], window))
        if out is None:
            out = marked(docs, MARKS, lambda b=block: _first(b))
        else:
            out = written(out, "marks").mapInArrow(_next(block), out.schema)
    return out


def _first(block):
    def step(batch, texts):
        n, spans, items, longest, at = zip(*look_up(block.value, texts))
        return {"n_words": n, "spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
                "items": items, "longest": longest, "longest_at": at}
    return step


def _next(block):
    """A pass with a further block over rows that have marks already."""
    def run(batches):
        for batch in batches:
            rows, at = batch.column(0), 0
            names = [f.name for f in rows.type]
            narrow = pa.RecordBatch.from_arrays([rows.field(names.index("text"))], names=["text"])
            for part, texts in text_slices(iter([narrow])):
                before = batch.slice(at, part.num_rows)
                at += part.num_rows
                old = before.drop_columns(["row"]).to_pylist()
                new = [_both(o, f) for o, f in zip(old, look_up(block.value, texts))]
                yield pa.RecordBatch.from_arrays(
                    [before.column(0), *(pa.array([n[f.name] for n in new], f.type)
                                         for f in list(batch.schema)[1:])], names=batch.schema.names)
    return run


def _both(old: dict, found: tuple) -> dict:
    n, spans, items, longest, at = found
    if old["longest"] > longest or old["longest"] == longest and 0 <= old["longest_at"] <= at:
        longest, at = old["longest"], old["longest_at"]
    return {"n_words": n, "items": sorted({*old["items"], *items}), "longest": longest,
            "longest_at": at, "spans": [{"start": a, "end": b} for a, b in merged(
                [(s["start"], s["end"]) for s in old["spans"]] + spans)]}


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at."""
    found = find_items(docs.select("doc_id", "text"), items, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), "longest", "longest_at")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    return find_items(docs, items, **options).where(F.size("spans") == 0).select("row.*")
