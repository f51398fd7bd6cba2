"""Near-duplicates against all pairs, and the pipeline against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import TABLES
from streamlat.llm import near_duplicates, queries
from streamlat.llm.support import read


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    """Set size and component of each document, by an index over all shingles."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root, index = {k: k for k in sets}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in sorted(sets):
        shared = {}
        for s in sets[k]:
            for other in index.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            index[s].append(k)
        for other, n in shared.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[other]) - n):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def changed(words, n, choose):
    words = list(words)
    for _ in range(n):
        words[choose.randrange(len(words))] = f"new{choose.randrange(10 ** 9)}"
    return words


@pytest.fixture(scope="module")
def family():
    """Copies, near copies of near copies, and one passage that many otherwise different documents share."""
    choose, texts = random.Random(11), {}
    passage = [f"p{i}" for i in range(60)]
    for i in range(150):
        texts[i] = [f"d{i}x{k}" for k in range(40)] + passage
    origin = [f"o{k}" for k in range(150)]
    for i in range(150, 330):
        texts[i] = changed(origin, choose.randint(0, 9), choose)
    chain = [f"c{k}" for k in range(120)]
    for i in range(400, 430):
        chain = changed(chain, 3, choose)
        texts[i] = chain
    texts = {k: " ".join(v) for k, v in texts.items()}
    return texts | {500: "One two", 501: "one  TWO", 502: "one two three", 503: "", 504: None, 505: texts[150]}


def test_components(spark, family):
    docs = spark.createDataFrame(list(family.items()), "doc_id long, text string").withColumns(
        {c: F.lit("own") for c in ("node", "row", "digest", "key", "gone", "again")})
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.components(docs).collect()}
    assert got == brute_components(family)


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates.components(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]
    kept = near_duplicates.one_of_each(spark.createDataFrame(rows + [(3, "x")], "doc_id long, text string"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3]
    assert near_duplicates.components(docs.limit(0)).collect() == []


def test_bounds_of_verification():
    least = near_duplicates.least_matches(5, 0.75, 1e-6)
    assert least == sorted(least) and least[0] < 0.75 * 32 and least[-1] < 0.75 * 160


def test_query(spark):
    texts = {r.doc_id: r.text for r in read(spark, TABLES, "documents").collect()}
    rows = queries.QUERIES["op6_near_duplicates"](spark, TABLES).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_components(texts)


def test_pipeline(spark):
    from test_native import base_spans
    from test_texts import brute
    from test_tokens import check_packed, library

    documents = {r.doc_id: r.text for r in read(spark, TABLES, "documents").collect()}
    kept = {k: t for k, t in documents.items() if any(map(str.isalpha, t or ""))}
    components = brute_components(kept)
    kept = {k: t for k, t in kept.items() if components[k][2]}
    items = [tuple(r) for r in read(spark, TABLES, "benchmark").collect()]
    kept = {k: t for (k, t), found in zip(kept.items(), brute(kept.values(), items)) if not found[-1]}
    rows = corpus_pipeline.run(spark, TABLES).collect()
    assert {r.doc_id for r in rows} == set(kept)
    check_packed(rows, 4096)
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    tokenizer = library("word_bpe_49k.json")
    for k, text in kept.items():
        for kind, a, b in sorted(base_spans(text), key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        assert lengths[k] == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1


def couples(n, choose):
    """Pairs of similar documents, two of different pairs not similar, on one long passage."""
    core, texts = [f"k{i}" for i in range(100)], {}
    for i in range(n):
        own = core + [f"c{i}x{k}" for k in range(30)]
        for k in range(2):
            texts[2 * i + k] = " ".join(own + [f"o{i}x{k}x{j}" for j in range(8)])
    keys = list(texts)
    choose.shuffle(keys)
    return {k: texts[j] for k, j in zip(range(len(keys)), keys)}


def in_bands(monkeypatch, same):
    """Let all documents share the bands in `same`, and no other."""
    sketch = near_duplicates.sketch
    bands = F.transform(F.sequence(F.lit(0), F.lit(near_duplicates.BANDS - 1)), lambda b: F.when(
        b.isin(same), b.cast("long")).otherwise(F.xxhash64("doc_id", b)))
    monkeypatch.setattr(near_duplicates, "sketch", lambda docs: sketch(docs).withColumn(
        "bands", F.when(F.size("bands") > 0, bands)))


def test_pairs_whose_shared_bands_are_all_hot(spark, monkeypatch):
    texts = couples(60, random.Random(2))
    expected = brute_components(texts)
    assert len({c for _, c, _ in expected.values()}) == 60
    in_bands(monkeypatch, [3, 8, 20])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in near_duplicates.components(docs).collect()} == expected


def test_variants_of_one_text_are_few_pairs(spark, monkeypatch):
    choose, origin = random.Random(4), [f"o{k}" for k in range(120)]
    texts = {i: " ".join(changed(origin, choose.randint(0, 12), choose)) for i in range(600)}
    held, verified = [], near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda pairs, *rest: (
        held.append(pairs.count()), verified(pairs, *rest))[1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in near_duplicates.components(docs).collect()} == brute_components(texts)
    assert len(held) <= 2 and sum(held) <= 20 * len(texts)


@pytest.mark.parametrize("band", [0, near_duplicates.BANDS - 1])
def test_no_bucket_gives_all_its_pairs(spark, monkeypatch, band):
    texts = {i: " ".join([f"k{k}" for k in range(100)] + [f"o{i}x{k}" for k in range(40)]) for i in range(300)}
    texts[300] = texts[200] + " more"
    held, verified = [], near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda pairs, *rest: (
        held.append(pairs.count()), verified(pairs, *rest))[1])
    in_bands(monkeypatch, [band])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.components(docs).collect()}
    assert got == {i: i for i in range(300)} | {300: 200}
    assert max(held) <= len(texts)


def test_clashing_ids_lose_no_text(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "quite another text of words"), (3, "u v w x y"),
            (3, "one two three four five six"), (3, "U v w x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("own"))
    kept = near_duplicates.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text.lower()) for r in kept.collect()) == [
        (1, "a b c d e f"), (2, "quite another text of words"), (3, "one two three four five six"), (3, "u v w x y")]
