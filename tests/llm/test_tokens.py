"""Token ids, counts, files and packing against the library and plain packing."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import TABLES
from streamlat.llm import arrow_files, packing, queries, token_counts
from streamlat.llm.support import read
from streamlat.llm.vocabulary import Encoder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PARTS = ["a", "aa", "aaa", "b", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x1c", "é", "é", "'s",
         "'ll", "1", "23", "½", "<|endoftext|>", "<|endof", "日本", "🙂", "\r\n", "...", "!?", "Σ"]


def odd_texts(n=3000):
    choose = random.Random(7)
    made = ["".join(choose.choice(PARTS) for _ in range(choose.randint(0, 25))) for _ in range(n)]
    return made + [" ".join(t) for t in made[:n // 3]] + ["", "x" * 30000, "a b " * 20000]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in read(spark, TABLES, "documents").collect()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_library(name):
    texts = odd_texts()
    ids, counts = Encoder(public_tokenizers.path(name))(pa.array([None, *texts]))
    want = [[], *(e.ids for e in library(name).encode_batch(texts, add_special_tokens=False))]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_pieces_of_a_batch_are_cut_together(name):
    encoder, calls = Encoder(public_tokenizers.path(name)), []
    find = encoder.find
    encoder.find = lambda text: calls.append(text) or find(text)
    made = [" ".join(f"w{i}x{k},\nÉ{k}" for k in range(100)) for i in range(50)]
    ids, counts = encoder(pa.array(made))
    want = [e.ids for e in library(name).encode_batch(made, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(calls) <= 2


def test_new_words_of_a_batch_are_normalized_together():
    name, calls = "word_bpe_49k.json", []
    encoder = Encoder(public_tokenizers.path(name))
    normalizer = encoder.normalizer

    class Counted:
        def normalize_str(self, text):
            calls.append(text)
            return normalizer.normalize_str(text)

    encoder.normalizer = Counted()
    made = [" ".join(f"É{i}x{k}Σ," for k in range(100)) + "  a\tb <|endoftext|>c " for i in range(50)]
    ids, counts = encoder(pa.array(made))
    want = [e.ids for e in library(name).encode_batch(made, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    # One for all words, one each for the empty piece and for the one with a tab.
    assert len(calls) <= 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_that_are_kept_keep_their_ids(name):
    encoder, texts = Encoder(public_tokenizers.path(name)), odd_texts(300)
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    for most in (1000, 7, 0):
        ids, counts = encoder(pa.array(texts))
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        encoder.keep(most)
        assert len(encoder.known) <= most and len(encoder.values) == encoder.ends[-1]


def test_counter_counts_what_the_library_gives():
    texts = odd_texts()
    got = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))(pa.array([*texts, None]))
    want = library("byte_bpe_50k.json").encode_batch([*texts, ""], add_special_tokens=False)
    assert got.tolist() == [len(w.ids) for w in want]


def test_forgetting_pieces_changes_nothing(monkeypatch):
    from streamlat.llm import vocabulary

    monkeypatch.setattr(vocabulary, "PIECES", 3)
    monkeypatch.setattr(token_counts, "PIECES", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, counter = Encoder(path), token_counts.Counter(path)
    for text in ["one two three", "four five six one", "two one"]:
        want = library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
        assert encoder(pa.array([text]))[0].tolist() == want
        assert counter(pa.array([text])).tolist() == [len(want)]


def test_token_counts(spark, texts):
    tokenizer = library("byte_bpe_50k.json")
    rows = queries.QUERIES["op4_token_counts"](spark, TABLES).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_arrow_sequences(spark, texts):
    tokenizer, start = library("byte_bpe_50k.json"), 0
    rows = {r.doc_id: r for r in queries.QUERIES["op3_arrow_sequences"](spark, TABLES).collect()}
    assert set(rows) == set(texts)
    for key in sorted(texts):
        ids = [*tokenizer.encode(texts[key], add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(rows[key]) == (key, start, len(ids), crc)
        start += len(ids)


def test_sequences_are_slices_of_the_file(spark, tmp_path):
    docs = spark.createDataFrame([(2, "a b " * 3000), (1, "x")], "doc_id long, text string")
    manifest = arrow_files.write_sequences(docs.coalesce(1), queries.BYTE_BPE, length=64,
                                           path=str(tmp_path)).collect()
    stream = np.concatenate([
        ids[mask.to_numpy(zero_copy_only=False)]
        for row in sorted(manifest) for k in range(-(-row.n_tokens // 64))
        for ids, mask in [arrow_files.sequence(row.ids_path, k)]])
    tokenizer = library("byte_bpe_50k.json")
    assert stream.tolist() == [*tokenizer.encode("x").ids, 0, *tokenizer.encode("a b " * 3000).ids, 0]


EDGES = [(1, None), (1, "twice"), (1, "twice"), (None, "no id"), (3, ""), (4, "long " * 9000)]


def edges(spark, rows=EDGES):
    """Documents with nulls, repeated rows and columns whose names the operators use inside."""
    made = spark.createDataFrame(list(rows), "doc_id long, text string")
    return made.withColumns({c: F.lit("own") for c in ("length", "task", "ids", "start", "n", "key")})


def test_edges_of_sequences(spark):
    tokens = arrow_files.read_documents(spark, arrow_files.write_sequences(edges(spark), queries.BYTE_BPE))
    rows = sorted(tokens.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 1, 3, 4]
    assert rows[4].n_tokens == 1 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    empty = arrow_files.write_sequences(edges(spark, []), queries.BYTE_BPE)
    assert arrow_files.read_documents(spark, empty).collect() == []


def test_edges_of_counts(spark):
    rows = token_counts.count_tokens(edges(spark), queries.BYTE_BPE).collect()
    assert len(rows) == len(EDGES)
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0]
    assert token_counts.count_tokens(edges(spark, []), queries.BYTE_BPE).collect() == []


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        room = min(fit) if fit else capacity
        if fit:
            rooms.remove(room)
        rooms.append(room - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_runs_are_best_fit_decreasing(seed):
    choose = random.Random(seed)
    capacity = choose.choice([1, 7, 10, 64, 100])
    lengths = [choose.randint(1, capacity) for _ in range(choose.randint(0, 300))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    placed, ranks = {}, {}
    for length, rank, n, each, first, offset in packing.best_fit_decreasing(counts, capacity):
        for i in range(n):
            placed.setdefault(first + i // each, []).append((offset + i % each * length, length))
            ranks.setdefault(length, []).append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    rooms = []
    for slots in placed.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        rooms.append(capacity - at)
    assert min(rooms, default=0) >= 0
    assert sorted(rooms) == plain_best_fit(lengths, capacity)


def check_packed(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing(spark, texts):
    tokenizer = library("word_bpe_49k.json")
    rows = queries.QUERIES["op8_best_fit_packing"](spark, TABLES).collect()
    want, lengths = {}, []
    for key, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at:at + 4096]
            want[key, k] = (at, len(piece), zlib.crc32(piece.tobytes()))
            lengths.append(len(piece))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    assert len(check_packed(rows, 4096)) == len(plain_best_fit(lengths, 4096))


def test_edges_of_packing(spark):
    rows = packing.pack(edges(spark), queries.WORD_BPE, capacity=1000).collect()
    assert sum(r.length for r in rows) == sum(
        len(library("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids) + 1
        for _, t in EDGES)
    check_packed(rows, 1000)
    assert packing.pack(edges(spark, []), queries.WORD_BPE).collect() == []


def test_packing_with_little_memory_gives_the_same_rows(spark):
    docs, path = read(spark, TABLES, "documents"), public_tokenizers.path("word_bpe_49k.json")
    plain = packing.cut_pieces(docs, path, end_id=1, capacity=512).drop("task", "place")
    small = packing.cut_pieces(docs, path, end_id=1, capacity=512, remembered=50, slice_bytes=4096).drop("task", "place")
    assert plain.exceptAll(small).count() == small.exceptAll(plain).count() == 0
