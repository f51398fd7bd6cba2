"""Tokens of each text, counted by merging all of a batch's pre-tokens at the same time.

The different pre-tokens of a batch lie end to end in one array of symbols. In each round
every pre-token finds its pair of lowest rank and merges it, all in array operations; a
pre-token without a known pair is finished. What is left are its tokens. Texts are sums
over their pre-tokens.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlat.llm.support import slices
from streamlat.llm.vocabulary import BYTE_PATTERN, PIECES, byte_letters, cut, sure

# Symbols merged at a time.
SYMBOLS = 1 << 20


class Merger:
    """Number of tokens of byte strings under the merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab, letters = content["model"]["vocab"], byte_letters()
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                 for m in content["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs] or [-1], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        self.special = [t["content"] for t in content.get("added_tokens", [])]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(
            self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole = any(any(map(str.isspace, s)) for s in self.special)
        self.find = regex.compile(BYTE_PATTERN).findall

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings stand between them."""
        if self.cut is None:
            return self.find(text), 0
        parts = self.cut.split(text)
        return [p for part in parts[::2] for p in self.find(part)], len(parts) // 2

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, in runs of about `SYMBOLS` bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        part = (np.cumsum(sizes) - sizes) // SYMBOLS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        return np.concatenate([np.zeros(0, np.int64), *(
            self._count(words[a:b], sizes[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a)])

    def _count(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        left = sizes.copy()
        none = len(self.made)
        while len(symbol):
            # Rank of the pair that starts at each symbol; a pair stays inside its word.
            rank = np.full(len(symbol), none)
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(best, np.diff(starts, append=len(word)))
            hit = (rank == lowest) & (rank < none)
            # Of overlapping equal pairs (a a a) every second one merges, from the left.
            touching = hit[1:] & hit[:-1]
            if touching.any():
                index = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(
                    hit & ~np.concatenate([[False], hit[:-1]]), index, -1))
                hit &= (index - begin) % 2 == 0
            symbol = np.where(hit, self.made[np.minimum(rank, none - 1)], symbol)
            left -= np.bincount(word[hit], minlength=len(left))
            # The right half of a merged pair goes, and so do words that are finished.
            gone = np.concatenate([[False], hit[:-1]]) | (lowest == none)
            symbol, word = symbol[~gone], word[~gone]
        return left


class Counter:
    """Tokens of texts. Holds the counts of a bounded number of pieces."""

    def __init__(self, path: str):
        self.merger, self.known = Merger(path), {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        coded, n_pieces = cut(texts)
        names = coded.dictionary.to_pylist()
        if len(self.known) > PIECES:
            self.known.clear()
        self._learn([p for p in names if p not in self.known])
        each = np.fromiter((self.known[p] for p in names), np.int64, len(names))
        each = each[coded.indices.to_numpy()]
        if not len(each):
            return each
        first = np.cumsum(n_pieces) - n_pieces
        # The line end put before each text is one token, and does not count.
        totals = np.add.reduceat(each, first) - 1
        for i in np.flatnonzero(np.minimum.reduceat(each, first) < 0).tolist():
            totals[i] = self._whole([texts[i].as_py() or ""])[0]
        return totals

    def _whole(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts whose pre-tokens are known only from the whole text."""
        tokens, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found, extra[i] = self.merger.pre_tokens(text)
            tokens += found
            owner += [i] * len(found)
        unique: dict[str, int] = {}
        back = [unique.setdefault(t, len(unique)) for t in tokens]
        each = self.merger.count([t.encode() for t in unique])[np.array(back, np.int64)]
        np.add.at(extra, np.array(owner, np.int64), each)
        return extra

    def _learn(self, new: list[str]) -> None:
        """Tokens of new pieces; -1 for those that may be part of longer tokens."""
        known = [p for p in new if not self.merger.whole and sure(p)]
        self.known.update(dict.fromkeys(new, -1))
        counts = self._whole([p if p[0] == "\n" else " " + p for p in known])
        self.known.update(zip(known, counts.tolist()))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of `docs`.

    A missing text is an empty one: no bytes, no tokens. Other columns are not read; a
    repeated row is counted each time it comes.
    """
    def run(batches):
        counter = Counter(path)
        for rows in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pc.binary_length(rows.column(1)).fill_null(0).cast(pa.int64()),
                 pa.array(counter(rows.column(1)))], names=["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def over_limit(n_tokens: Column, limit: int = 512) -> Column:
    return n_tokens > limit
