"""Runs of words, hard negatives and exact copies against plain Python."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TABLES
from streamlat.llm import exact_copies, hard_negatives, periodic_runs, queries
from streamlat.llm.support import WordHashes, read

# --- runs of words -------------------------------------------------------------------


def brute_runs(words, least_words=24, least_periods=3):
    """Every period on its own, by comparing the words with those a period further on."""
    number = {w: i for i, w in enumerate(sorted(set(words)))}
    x = np.array([number[w] for w in words], np.int64)
    found = {}
    for p in range(1, len(x) // least_periods + 1):
        same = np.concatenate([[False], x[p:] == x[:-p], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + p >= max(least_words, least_periods * p):
                found.setdefault((a, b - a + p), p)  # of two periods of one stretch the smaller
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n), rng.randint(1, 20)
        for i in range(a, rng.randint(a, n)):
            words[i] = words[a + (i - a) % p] if rng.random() < 0.99 else words[i]
    return words


def test_all_runs_of_two_periods():
    rng = random.Random(5)
    for _ in range(600):
        words = periodic(rng, rng.randint(1, 40), rng.randint(1, 4))
        assert periodic_runs.all_runs(words) == brute_runs(words, 2, 2)


def test_long_runs():
    rng, hashes = random.Random(6), WordHashes()
    for _ in range(200):
        words = [b"%d" % w for w in periodic(rng, rng.randint(20, 200), rng.randint(1, 30))]
        assert periodic_runs.long_runs(words, hashes) == brute_runs(words)


def test_no_window_of_a_run_stands_alone():
    assert periodic_runs.SURE == 9
    for q in range(1, 200):
        assert max(24, 3 * q) - periodic_runs.SURE + 1 >= 2 * q


def test_suffix_order_and_extensions():
    rng = random.Random(7)
    for _ in range(100):
        text = [rng.randrange(3) for _ in range(rng.randint(2, 30))]
        tree = periodic_runs.SuffixTree(text)
        tour, place, order = tree.euler_tour()
        assert order.tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])
        turned = tree.euler_tour(descending=True)[2].tolist()
        assert turned == sorted(range(len(text) + 1), key=lambda i: [-x for x in text[i:]])
        a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(text)) for j in range(i)] or [(1, 0)]))
        common = [next((k for k in range(len(text) - i) if text[i + k] != text[j + k]), len(text) - i)
                  for i, j in zip(a, b)]
        assert periodic_runs.Extensions(tour, place)(a, b).tolist() == common


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_summary(doc_id, text):
    words = [w.decode() for w in queries.with_cycle(doc_id, (text or "").encode().split())]
    found = brute_runs(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{m},{p}\n" for s, m, p in found)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_the_whole_table(spark):
    rows = read(spark, TABLES, "documents").collect()
    got = queries.QUERIES["op11_periodic_runs"](spark, TABLES).collect()
    want = {r.doc_id: expected_summary(r.doc_id, r.text) for r in rows}
    assert {r.doc_id: tuple(r) for r in got} == want and len(got) == len(rows)
    assert sum(r.n_runs for r in got) > 10


def test_runs_of_odd_rows(spark):
    cycle = " ".join(["a", "b c", "é"] * 2000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, cycle), (4, cycle), (None, cycle), (5, "x " * 23), (6, "x " * 24),
            (7, " ".join(map(str, range(60_000))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("own"))
    got = {(r.doc_id, r.n_words): r for r in periodic_runs.find(docs).collect()}
    assert [r.asDict() for r in got[4, 6000].runs] == [{"start": 0, "length": 6000, "period": 3}]
    assert got[4, 6000].collapsed == got[None, 6000].collapsed == "a b c é"
    assert [got[k].runs for k in [(1, 0), (2, 0), (3, 0), (5, 23), (7, 60_000)]] == [[]] * 5
    assert got[6, 24].collapsed == "x" and got[1, 0].best is None
    assert periodic_runs.find(docs).count() == len(rows)
    assert periodic_runs.summary(periodic_runs.find(docs.limit(0))).collect() == []


# --- hard negatives ------------------------------------------------------------------


@pytest.mark.parametrize("m, k, n", [(1, 1, 1), (17, 33, 21), (40, 0, 40), (64, 64, 64), (100, 65, 37)])
def test_strassen(m, k, n):
    rng = np.random.default_rng(m)
    a, b = rng.integers(-2**27, 2**27, (m, k)), rng.integers(-2**27, 2**27, (k, n))
    assert (hard_negatives.strassen(a, b) == (a.astype(object) @ b.astype(object))).all()


def brute_negatives(rows, anchor):
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, label, vector in {r for r in rows if anchor(r[0])}:
        near = {(-score(vector, v), j) for j, m, v in rows if j != i and m == label}
        far = {(-score(vector, v), j) for j, m, v in rows if m != label}
        for s, j in sorted(near)[:5]:
            inside = sorted(x for x in far if 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out |= {(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(inside, 1)}
    return out


def mined(spark, rows, anchor="vec_id % 3 = 0"):
    made = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>").repartition(5)
    return hard_negatives.mine(made, F.expr(anchor)).collect()


def test_hard_negatives_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), tuple(rng.randint(-2, 3) for _ in range(rng.randint(5, 7)))) for i in range(300)]
    rows += [(i, 1, rows[0][2]) for i in range(300, 420)] + rows[:30]  # ties, repeated rows
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2000)
    got = mined(spark, rows)
    assert {tuple(r) for r in got} == brute_negatives(rows, lambda i: i % 3 == 0)
    assert len(got) == len({tuple(r) for r in got}) > 1000


def test_heaps_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(9)
    scores, ids = rng.integers(0, 6, (20, 400)), np.arange(400)
    allowed = rng.random((20, 400)) < 0.5
    whole, parts = hard_negatives.Heaps(20, 4), hard_negatives.Heaps(20, 4)
    whole.push(np.arange(20), scores, allowed, ids)
    for at in (300, 0, 100, 200):
        part = hard_negatives.Heaps(20, 4)
        part.push(np.arange(20), scores[:, at:at + 100], allowed[:, at:at + 100], ids[at:at + 100])
        key, _, score, item = part.entries()
        parts.merge(key, score, item)
    for a, b in zip(whole.entries(), parts.entries()):
        assert (a == b).all()
    for key in range(20):
        best = sorted((-s, i) for s, i, ok in zip(scores[key], ids, allowed[key]) if ok)[:4]
        assert [(-s, i) for s, i in zip(whole.score[key], whole.id[key])] == best


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.75, 0.75]), (3, None, [0.5, 0.5]), (4, 2, None),
            (5, 2, [0.5, None]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [1e30, 1.0]), (None, 2, [0.5, 0.5]),
            (9, 2, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("vector", F.lit(1))
    used = hard_negatives.usable(table)
    assert sorted(r.vec_id for r in used.collect()) == [0, 1, 2, 9]
    assert {r.vec_id: r.vector for r in used.collect()}[2] == [192, 192]
    assert [tuple(r) for r in hard_negatives.mine(used, F.expr("vec_id = 0")).collect()] == [
        (0, 1, 1, 2, 128 * 256 + 256 * 256, 128 * 192 + 256 * 192)]
    for none in (used.limit(0), used.where("label = 1"), used.where("vec_id = 0")):
        assert hard_negatives.mine(none, F.expr("vec_id = 0")).collect() == []


# --- exact copies --------------------------------------------------------------------

ODD = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "É"), (None, "a b"), (None, "alone"),
       (None, "alone"), (8, "x" * 300_000), (9, "X" * 300_000), (9, "X" * 300_000), (10, "K"), (11, "K")]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted([(i, keep[lowered(t)], len(groups[lowered(t)])) for i, t in rows], key=str)


def table_of(spark, rows, path, files):
    (spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("own"))
     .withColumn("_metadata", F.lit(1)).withColumn("file", F.lit("own")).repartition(files).write.mode("append").parquet(path))


def seen(found):
    return sorted([(r.doc_id, r.keep_id, r.group_size) for r in found.collect()], key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_copies_over_batches_and_a_restart(spark, tmp_path, weak):
    digest = (lambda text: F.unhex(F.hex(F.length(text) % 3))) if weak else exact_copies.sha256
    path, folder = str(tmp_path / "table"), str(tmp_path / "state")
    table_of(spark, ODD, path, 4)
    first = exact_copies.deduplicate(spark, path, folder, digest=digest, files=1)
    assert seen(first) == brute_copies(ODD)
    more = [(20, "a b"), (21, "new"), (0, "NEW"), (22, "a b")]
    table_of(spark, more, path, 2)
    second = exact_copies.deduplicate(spark, path, folder, digest=digest, files=1)
    assert seen(second) == brute_copies(ODD + more)
    kept = [(r.doc_id, r.kept) for r in second.collect()]
    assert {i for i, k in kept if k and i is not None} == {22, 4, 6, 7, 9, 10, 11, 21}
    assert kept.count((None, True)) == 1 and kept.count((9, True)) == 2
    # The earlier files were not read again.
    offsets = sorted(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    assert len(offsets) >= 6


def test_copies_of_an_empty_table(spark, tmp_path):
    table_of(spark, ODD[:0], str(tmp_path / "none"), 1)
    assert exact_copies.deduplicate(spark, str(tmp_path / "none")).collect() == []


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with exact_copies.settings(spark, {"spark.sql.streaming.stateStore.providerClass": "x", "own.key": "1"}):
        assert spark.conf.get("own.key") == "1"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert spark.conf.get("own.key", None) is None


def test_the_state_is_a_row_for_each_text(spark, tmp_path):
    path, folder = str(tmp_path / "table"), str(tmp_path / "state")
    table_of(spark, [(i, "one") for i in range(500)] + [(i, f"text {i}") for i in range(500, 520)], path, 3)
    hits = exact_copies.remember(spark, path, folder, files=2)
    assert [(r.keep_id, r.group_size) for r in hits.collect()] == [(499, 500)]
    assert spark.read.format("statestore").load(folder).count() == 21
    assert exact_copies.collisions(hits, spark.read.parquet(path), exact_copies.sha256).isEmpty()
