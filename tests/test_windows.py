from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamlat.functions.exact import exact_sum, integer_mean
from streamlat.operators import parity, windows


def means(df, width="2 seconds"):
    df = (df.transform(parity.with_parity).transform(windows.window_sums, width)
            .transform(windows.window_mean))
    return {(r.window_start_ms, r.parity): (r.n, int(r.sum_seq), int(r.sum_created_ms),
                                            r.avg_created_ms) for r in df.collect()}


def by_hand(pairs, width_ms):
    groups = defaultdict(list)
    for seq, created in pairs:
        groups[created // width_ms * width_ms, "odd" if seq % 2 else "even"].append((seq, created))

    def cut(total, n):
        return abs(total) // n * (1 if total >= 0 else -1)

    return {key: (len(rows), sum(s for s, _ in rows), sum(c for _, c in rows),
                  cut(sum(c for _, c in rows), len(rows))) for key, rows in groups.items()}


def test_one_record_keeps_its_creation_time(typed):
    assert means(typed((7, 1234))) == {(0, "odd"): (1, 7, 1234, 1234)}


def test_the_mean_is_cut(typed):
    assert means(typed((2, 1), (4, 2)))[0, "even"][3] == 1
    assert means(typed((2, -1), (4, -2)))[-2000, "even"][3] == -1


def test_window_bounds(typed):
    got = means(typed((1, 0), (1, 1999), (1, 2000), (1, -1)))
    assert {key[0]: value[0] for key, value in got.items()} == {-2000: 1, 0: 2, 2000: 1}


def test_nothing_in_nothing_out(typed):
    assert means(typed((1, 1)).where("false")) == {}


TIMES = st.integers(-10_000, 10_000) | st.integers(1_700_000_000_000, 1_700_000_010_000)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-2**63, 2**63 - 1), TIMES), min_size=1, max_size=200))
def test_any_records(spark, pairs):
    df = spark.createDataFrame(pairs, "seq bigint, created_ms bigint")
    assert means(df) == by_hand(pairs, 2000)


def test_sums_beyond_64_bits(spark):
    # Six million records of about 1.7e12 in one window and two keys.
    df = spark.range(12_000_000).select(F.col("id").alias("seq"),
                                        F.lit(1_700_000_000_000).alias("created_ms"))
    got = means(df, "10 seconds")
    assert got[1_700_000_000_000, "odd"] == (
        6_000_000, 36_000_000_000_000, 6_000_000 * 1_700_000_000_000, 1_700_000_000_000)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-2**63, 2**63 - 1), min_size=1, max_size=300))
def test_exact_sum_and_mean(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "x bigint").repartition(4)
    row = df.agg(exact_sum("x").alias("s"), F.count("x").alias("n")).withColumn(
        "m", integer_mean("s", "n")).collect()[0]
    total = sum(numbers)
    assert int(row.s) == total
    assert row.m == abs(total) // len(numbers) * (1 if total >= 0 else -1)


def test_one_hot_window_sends_a_handful_of_rows(spark):
    # All rows share a window and two thirds share a key; each task combines its own first.
    df = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("seq"),
        F.lit(5).cast("long").alias("created_ms"))
    assert means(df)[0, "odd"][0] == 200_000
    plan = (df.transform(parity.with_parity).transform(windows.window_sums, "2 seconds")
              ._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_arrival_windows_hold_the_whole_batch(typed):
    df = typed((1, 5), (2, 9_999_999), (3, 7)).transform(parity.with_parity)
    rows = df.transform(windows.window_sums, "2 seconds", time=windows.arrival_time()).collect()
    assert {r.parity: r.n for r in rows} == {"odd": 2, "even": 1}
    assert len({r.window_start_ms for r in rows}) == 1 and rows[0].window_start_ms % 2000 == 0


def test_further_totals(typed):
    df = typed((1, 5), (3, 7)).withColumn("load", F.col("seq") * 10).transform(parity.with_parity)
    row = df.transform(windows.window_sums, "2 seconds", totals=("load",)).collect()[0]
    assert row.sum_load == 40
