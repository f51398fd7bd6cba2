"""Runs: stretches of a text in which the same words come again and again, and the text without the repeats.

A run is a longest stretch of words with a smallest period. Each run has a Lyndon root, the longest Lyndon
word at its own start in the order of words or in the opposite order. So the candidates are two per word:
the suffix tree gives the ranks of the suffixes, and the longest Lyndon word at a place ends where the next
smaller suffix begins. How far the period holds to the right is the longest common extension of the root's
two ends; to the left it is the same on the reversal. Both are answered in constant time as the lowest
common ancestor of two leaves, by range minima over the Euler tours of two Ukkonen trees.

A stretch that long repeats itself at least three times, so each `SURE` words in a row inside it come twice
or more there. Texts are cut at words for which that is not so, which loses no run, and only what is left
gets its trees.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlat.llm.support import WordHashes, hashed, map_texts, runs as windows

LEAST_WORDS = 24    # of a run
LEAST_PERIODS = 3   # of a run

# Of a run of max(24, 3q) words with period q, the windows of 9 words are 2q or more for each q.
SURE = min(max(LEAST_WORDS, LEAST_PERIODS * q) - 2 * q + 1 for q in range(1, LEAST_WORDS + 1))

RUN = "struct<start:long,length:long,period:long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"

END = -1            # below each symbol


class SuffixTree:
    """Ukkonen's tree of a list of symbols (0 and up), closed by `END`.

    Node 0 is the root; `first` and `last` bound the edge above a node, `children` has None for leaves.
    """

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, END]
        self.first, self.last, self.children = first, last, children = [0], [0], [{}]
        link, size = [0], len(text)
        node = edge = along = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not along:
                    edge = i
                kids, head = children[node], text[edge]
                child = kids.get(head)
                if child is None:
                    kids[head] = len(first)
                    first.append(i)
                    last.append(size)
                    link.append(0)
                    children.append(None)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = first[child]
                    reach = min(last[child], i + 1) - begin
                    if along >= reach:
                        node, edge, along = child, edge + reach, along - reach
                        continue
                    middle = text[begin + along]
                    if middle == symbol:
                        along += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(first)
                    first += (begin, i)
                    last += (begin + along, size)
                    link += (0, 0)
                    children += ({middle: child, symbol: inner + 1}, None)
                    first[child] = begin + along
                    kids[head] = inner
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = i - waiting + 1

    def euler_tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text depth of each step of the tour, the step of each suffix's leaf, and the suffixes in their order.

        `descending` turns the order of the symbols round; the end stays below all of them.
        """
        first, last, children, size = self.first, self.last, self.children, len(self.text)
        tour, leaves = [], []
        place = np.zeros(size, np.int64)
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            tour.append(depth)
            if node < 0:
                continue
            kids = children[node]
            if kids is None:
                place[size - depth] = len(tour) - 1
                leaves.append(size - depth)
                continue
            order = sorted(kids, reverse=not descending)
            if descending and END in kids:
                order.append(order.pop(0))
            for symbol in order:
                child = kids[symbol]
                stack.append((-1, depth))
                stack.append((child, depth + last[child] - first[child]))
        return np.array(tour, np.int32), place, np.array(leaves, np.int64)


class Extensions:
    """Longest common prefix of two different suffixes: the least depth between their leaves in the tour."""

    def __init__(self, tour: np.ndarray, place: np.ndarray):
        self.place, self.table = place, [tour]
        width = 1
        while 2 * width <= len(tour):
            row = self.table[-1]
            self.table.append(np.minimum(row[:-width], row[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k)) + 1])
        return out


def lyndon_ends(suffixes: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place ends, from the suffixes in their order (the end first)."""
    rank = np.empty(len(suffixes), np.int64)
    rank[suffixes] = np.arange(len(suffixes))
    ends, open_, ranks = [0] * (len(rank) - 1), [], rank.tolist()
    for i, now in enumerate(ranks):
        while open_ and ranks[open_[-1]] > now:
            ends[open_.pop()] = i
        open_.append(i)
    return np.array(ends, np.int64)


def all_runs(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of two periods or more, by start, then period."""
    n = len(symbols)
    if n < 2:
        return []
    tree = SuffixTree(symbols)
    tour, place, upward = tree.euler_tour()
    downward = tree.euler_tour(descending=True)[2]
    right = Extensions(tour, place)
    left = Extensions(*SuffixTree(symbols[::-1]).euler_tour()[:2])
    start = np.tile(np.arange(n), 2)
    end = np.concatenate([lyndon_ends(upward), lyndon_ends(downward)])
    period = end - start
    after = right(start, end)
    # The text before a place is the reversal's suffix n - place; before the first word there is nothing.
    before = left(n - start, n - end)
    whole = after + before >= period
    found = {(int(s), int(m), int(p)) for s, m, p in
             zip((start - before)[whole], (period + before + after)[whole], period[whole])}
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the parts in which each window of `SURE` words comes twice or more; all runs lie in them."""
    done, open_ = [], [(0, len(hashes))]
    while open_:
        start, end = open_.pop()
        if end - start < LEAST_WORDS:
            continue
        grams = windows(hashes[start:end], SURE)
        ordered = np.sort(grams)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            continue
        alive = np.concatenate([[False], np.isin(grams, again), [False]])
        edges = np.flatnonzero(alive[1:] != alive[:-1])
        parts = [(start + int(a), start + int(b) + SURE - 1) for a, b in zip(edges[::2], edges[1::2])]
        if parts == [(start, end)]:
            done += parts
        else:
            open_ += parts
    return sorted(done)


def long_runs(words: list[bytes], hashes: WordHashes) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `LEAST_WORDS` and `LEAST_PERIODS` or more, by start, then period."""
    found = set()
    for start, end in stretches(hashed(words, hashes)):
        numbers: dict[bytes, int] = {}
        symbols = [numbers.setdefault(w, len(numbers)) for w in words[start:end]]
        found.update((start + s, m, p) for s, m, p in all_runs(symbols)
                     if m >= LEAST_WORDS and m >= LEAST_PERIODS * p)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; of equal ones the first, then that of the least period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs, best and collapsed of each row of `docs` (doc_id, text).

    Words are what white space of ASCII separates. `runs` are ordered by start, then period; `best` is the
    strongest of them, NULL if there is none; `collapsed` are the words that are left, joined by a space.
    `prepare` may give other words for those of a row. A missing, empty or blank text has no words and no
    runs. Repeated rows come out each time, also those without doc_id. Other columns are not read. A text is
    held whole in one task: its trees take about 1 KB a word of the stretches that may hold a run.
    """
    def make():
        hashes = WordHashes()

        def step(batch, texts):
            ids = batch.column(0).to_pylist()
            made = {"doc_id": batch.column(0), "n_words": [], "runs": [], "best": [], "collapsed": []}
            for doc_id, text in zip(ids, texts):
                words = text.encode().split()
                if prepare:
                    words = prepare(doc_id, words)
                found = long_runs(words, hashes)
                best = strongest(found)
                made["n_words"].append(len(words))
                made["runs"].append([named(r) for r in found])
                made["best"].append(named(best) if best else None)
                made["collapsed"].append(b" ".join(collapse(words, found)))
            made["collapsed"] = pa.array(made["collapsed"], pa.binary()).cast(pa.string())
            return made
        return step

    def named(run):
        return dict(zip(("start", "length", "period"), run))

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), FOUND, make)


def summary(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what `find` gives."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
