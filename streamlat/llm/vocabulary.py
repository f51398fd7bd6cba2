"""Token ids of whole texts, by way of the pieces that no token can cross.

Encoding a text word by word in the library is slow, and texts repeat their words. So a
batch of texts is cut at blanks and line ends where the tokenizer is sure to cut as well,
each different piece is encoded once, and the ids are put together again. New pieces of a
batch are normalized and cut together, and the library's model merges each different
pre-token. Texts in which white space meets white space have no such sure cuts; they go to
the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, compress, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from streamlat.llm.support import release

# Pieces that an encoder remembers, before it starts anew; about 250 bytes each. Of these, three in ten stay for
# the next task of the same worker process: the first met, mostly frequent ones.
PIECES = 1_000_000

# Pre-tokens whose tokens are held as objects at a time.
CALL = 4096

# Fixed value: white space by Python's `str.split`, but for the line end.
BLANKS = r"\t\x0b-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# A piece that is not `sure`, as Arrow's pattern.
UNSURE = rf"(?s)^\n?$|^[{BLANKS}]|.[\n{BLANKS}]"

# Fixed value: the pattern by which byte-level vocabularies cut texts before any merge.
BYTE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                r"|\s+(?!\S)|\s+")


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of all texts, and how many each text has.

    Every line begins a piece, which then starts with its line end; the first line gets
    one too. Every other piece stood behind one blank.
    """
    started = pc.binary_join_element_wise("\n", texts.fill_null(""), "")
    lists = pc.split_pattern(pc.replace_substring(started, "\n", " \n"), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    flat = lists.flatten()
    # What stands before the first line end is empty, and is left out.
    keep = np.ones(len(flat), bool)
    keep[np.cumsum(sizes + 1) - (sizes + 1)] = False
    return flat.filter(pa.array(keep)).dictionary_encode(), sizes


def strings(names: pa.Array) -> list[str]:
    """A list of strings, without an Arrow scalar for each."""
    return names.to_numpy(zero_copy_only=False).tolist()


def sure(piece: str) -> bool:
    """No white space in the piece or at its ends, but for the line end that begins it."""
    inner = piece[1:] if piece[:1] == "\n" else piece
    return inner.split() == [inner]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if printable, else one above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start:start + size], one after another."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return values[at]


class Encoder:
    """Ids of texts under a vocabulary file of the tokenizers library.

    Knows two kinds of files: byte-level ones that keep white space, and those that cut
    by a pattern and drop it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.dtype = id_type(self.library.get_vocab_size(with_added_tokens=True))
        self.special = [t["content"] for t in content.get("added_tokens", [])]
        # A special string with white space inside could reach over a cut.
        self.whole = any(any(map(str.isspace, s)) for s in self.special)
        before = content["pre_tokenizer"]
        steps = before.get("pretokenizers", [before])
        self.keeps_blanks = steps[0]["type"] == "ByteLevel"
        # Pieces are cut together: what stands before each comes out as a pre-token of its own.
        self.closing = "\n" if self.keeps_blanks else " "
        self.find = regex.compile(BYTE_PATTERN if self.keeps_blanks
                                  else f"(?:{steps[0]['pattern']['Regex']})|[ ]").findall
        self.normalizer = self.library.normalizer
        self.merges = self.library.model.tokenize
        # The model takes a letter for each byte. No pre-token here has a tab, which parts them in one string.
        self.letters = {byte: letter for letter, byte in byte_letters().items() if byte != 0x09}
        self.line_end = len(self._ids("\n"))
        self.most = PIECES
        self._forget()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _forget(self) -> None:
        # The number of each piece, and where the ids of each number end. Number 0 has none and is for pieces
        # that may be part of longer tokens.
        self.known: dict[str, int] = {}
        self.values, self.ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def keep(self, most: int) -> None:
        """Forget all but the pieces first met."""
        if len(self.known) > most:
            self.known = dict(islice(self.known.items(), most))
            self.ends = self.ends[:max(self.known.values(), default=0) + 1].copy()
            self.values = self.values[:self.ends[-1]].copy()

    def _learn(self, names: pa.Array) -> None:
        """Remember the ids of new pieces, or that they may be part of longer tokens."""
        unsure = np.asarray(pc.match_substring_regex(names, UNSURE))
        special = np.zeros(len(names), bool)
        for text in self.special:
            special |= np.asarray(pc.match_substring(names, text))
        if self.keeps_blanks:
            self.known.update(dict.fromkeys(strings(names.filter(pa.array(unsure))), 0))
            alone, special = [], special & ~unsure
        else:
            alone = strings(names.filter(pa.array(unsure & ~special)))
        marked = strings(names.filter(pa.array(special)))
        self._remember(marked, [self._ids(self._with_blank(p)) for p in marked])
        self._merge(alone, *self._one_by_one(alone))
        pieces = strings(names.filter(pa.array(~unsure & ~special)))
        self._merge(pieces, *self._together(pieces))

    def _remember(self, pieces: list[str], ids: list[np.ndarray], sizes: np.ndarray | None = None) -> None:
        if sizes is None:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(pieces, range(len(self.ends), len(self.ends) + len(pieces))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.values = np.concatenate([self.values, *ids])

    def _with_blank(self, piece: str) -> str:
        return piece if piece[:1] == "\n" else " " + piece

    def _one_by_one(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all pieces, one after another, and how many each has."""
        texts = [self._with_blank(p) for p in pieces] if self.normalizer is None else [
            self.normalizer.normalize_str(p) for p in pieces]
        found = [self.find(t) for t in texts]
        if not self.keeps_blanks:
            found = [[t for t in tokens if t != self.closing] for tokens in found]
        return list(chain.from_iterable(found)), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The same for sure pieces, in one call."""
        text = " ".join(["", *pieces])
        if self.keeps_blanks:
            # A piece begins with its line end, or with one put before its blank.
            text = text.replace(" ", "\n ").replace("\n \n", "\n")
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        tokens = self.find(text)
        at = np.flatnonzero(np.fromiter(map(self.closing.__eq__, tokens), bool, len(tokens)))
        if len(at) != len(pieces):  # white space that only the tokenizer takes for such
            return self._one_by_one(pieces)
        sizes = np.diff(at, append=len(tokens))
        put = np.ones(len(pieces), bool)
        if self.keeps_blanks:
            put = np.fromiter((p[0] != "\n" for p in pieces), bool, len(pieces))
        kept = np.ones(len(tokens), bool)
        kept[at[put]] = False
        return list(compress(tokens, kept.tolist())), sizes - put

    def _merge(self, pieces: list[str], tokens: list[str], sizes: np.ndarray) -> None:
        """Remember pieces by their pre-tokens, each different one of which is merged once."""
        numbers = dict(zip(dict.fromkeys(tokens), range(len(tokens))))
        order = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        unique, ids, each = list(numbers), [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(unique), CALL):
            words = "\t".join(unique[at:at + CALL]).encode().decode("latin-1").translate(self.letters).split("\t")
            made = [[t.id for t in self.merges(w)] for w in words]
            each.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids.append(np.fromiter(chain.from_iterable(made), self.dtype, int(each[-1].sum())))
        each = np.concatenate(each)
        starts, each = (np.cumsum(each) - each)[order], each[order]
        before = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(sizes)
        self._remember(pieces, [spread(np.concatenate(ids), starts, each)], before[ends] - before[ends - sizes])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        coded, n_pieces = cut(texts)
        pieces = strings(coded.dictionary)
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = number < 0
        if len(self.known) > self.most:
            self._forget()
            new[:] = True
        self._learn(coded.dictionary.filter(pa.array(new)))
        number[new] = np.fromiter(map(self.known.__getitem__, compress(pieces, new.tolist())), np.int64)
        unsure = number == 0
        begins = self.ends[np.maximum(number - 1, 0)]
        sizes = self.ends[number] - begins
        at = coded.indices.to_numpy()
        first = np.cumsum(n_pieces) - n_pieces
        starts, each = begins[at], sizes[at]
        # The line end put before each text does not count.
        starts[first] += np.minimum(self.line_end, each[first])
        each[first] -= np.minimum(self.line_end, each[first])
        odd = np.logical_or.reduceat(unsure[at], first) if len(at) else np.zeros(0, bool)
        if self.whole:
            odd[:] = True
        each[np.repeat(odd, n_pieces)] = 0
        out, counts = spread(self.values, starts, each), np.add.reduceat(each, first) \
            if len(at) else np.zeros(0, np.int64)
        if not odd.any():
            return out, counts
        cuts = np.cumsum(counts)
        rows = np.split(out, cuts[:-1])
        for i in np.flatnonzero(odd).tolist():
            rows[i] = self._ids(texts[i].as_py() or "")
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@contextmanager
def encoding(path: str, remembered: int = PIECES) -> Iterator[Encoder]:
    """The encoder of this worker process for one task, after which most of what it remembers goes."""
    encode = _encoder(path)
    encode.most = remembered
    try:
        yield encode
    finally:
        encode.keep(remembered * 3 // 10)
        release()


def id_type(size: int) -> str:
    """The narrower of two little-endian types that holds ids below `size`."""
    return "<u2" if size <= 1 << 16 else "<u4"
