import time

import pytest
from pyspark.sql import functions as F

from streamlat.operators import records
from streamlat.sources import load


def walk(start_ns, min_ns, step_s, percent, records_wanted):
    """The load record by record: a crossing record is sent, then the delay drops."""
    now = step = 0
    delay, sent = start_ns, []
    while len(sent) < records_wanted:
        sent.append(now)
        if delay > min_ns and now - step > step_s * 10**9:
            step, delay = now, int(delay - delay * (percent / 100))
        now += delay
    return sent


CASES = [
    (50_000_000, 20_000_000, 2, 25),
    (50_000_000, 50_000_000, 2, 25),   # nothing to cut
    (7_654_321, 1_000, 1, 33.3),       # far below the minimum at the end
    (1_000_000_000, 10_000_000, 1, 50),
    (900_000_000, 1, 0, 1),            # hundreds of steps, one per record
    # The percentage is divided before it is taken of the delay.
    (50_000_000, 20_000_000, 0, 33.7),
    (73_000_000, 1_000, 0, 34.2),
    (100_000_000, 1_000, 0, 55),
    (1_000_000_000, 1_000, 0, 0.1),    # thousands of steps
]


@pytest.mark.parametrize("case", CASES)
def test_ramp_equals_the_walk(spark, case):
    want = walk(*case, 5_000)
    steps = load.ramp_steps(*case)
    rows = spark.range(5_000).select(load.sent_ns("id", steps).alias("t")).collect()
    assert [r.t for r in rows] == want


@pytest.mark.parametrize("case, total_s", [(CASES[0], 20), (CASES[0], 1), (CASES[2], 3)])
def test_records_within_a_time(case, total_s):
    want = sum(t < total_s * 10**9 for t in walk(*case, 50_000))
    assert load.records_within(load.ramp_steps(*case), total_s) == want


def test_known_ramp():
    steps = load.ramp_steps(50_000_000, 20_000_000, 2, 25)
    assert load.records_within(steps, 20) == 1_014
    assert steps[1] == (41, 2_050_000_000, 37_500_000)
    assert steps[-1].delay_ns < 20_000_000  # the last cut may land below the minimum


def test_cuts_of_one_nanosecond():
    assert load.ramp_steps(50_000_000, 40_000_000, 1, 33.7)[1].delay_ns == 33_150_000
    assert load.ramp_steps(100_000_000, 50_000_000, 1, 55)[1].delay_ns == 44_999_999


def test_a_ramp_may_have_any_number_of_steps(spark):
    steps = load.ramp_steps(1_000_000_000, 1_000, 1, 0.1)
    assert len(steps) == 13_387
    seqs = [steps[k].first_seq + d for k in (0, 1, 5_000, 13_385) for d in (0, 1)]
    rows = spark.createDataFrame([(s,) for s in seqs], "seq long").select(
        load.sent_ns("seq", steps).alias("t")).collect()
    assert [r.t for r in rows] == [
        steps[k].start_ns + d * steps[k].delay_ns for k in (0, 1, 5_000, 13_385) for d in (0, 1)]


def test_constant_load(spark):
    lines = load.load_lines(spark, 5, load.constant_steps(1_500_000), 1000)
    assert [r.line for r in lines.collect()] == ["0 1000", "1 1001", "2 1003", "3 1004", "4 1006"]
    flat = load.load_lines(spark, 3, load.constant_steps(0), 1000)
    assert [r.line for r in flat.collect()] == ["0 1000", "1 1000", "2 1000"]


def test_load_is_made_in_parallel(spark):
    lines = load.load_lines(spark, 1000, load.ramp_steps(*CASES[0]), 0, partitions=5)
    assert lines.rdd.getNumPartitions() == 5
    parsed = lines.transform(records.parse_lines).select("seq").collect()
    assert [r.seq for r in parsed] == list(range(1000))


def test_steps_are_made_no_further_than_asked(spark):
    began = time.monotonic()
    for percent in (0.00001, 1e-15):  # ten million steps; a cut that is lost in the double
        ramp = (10_000_000, 1_000, 0, percent)
        lines = load.ramp_lines(spark, *ramp, t0_ms=0, records=10_000)
        want = [f"{i} {t // 1_000_000}" for i, t in enumerate(walk(*ramp, 10_000))]
        assert sorted((r.line for r in lines.collect()), key=lambda x: int(x.split()[0])) == want
    assert len(load.ramp_steps(10_000_000, 1_000, 0, 1e-15)) == 1
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("case", CASES[:5])
def test_the_table_equals_the_walk(spark, case):
    steps = load.ramp_steps(*case, records=5_000)
    rows = load.sent_table(spark, steps, 5_000).orderBy("seq").collect()
    assert [(r.seq, r.sent_ns) for r in rows] == list(enumerate(walk(*case, 5_000)))


def test_lines_of_so_many_seconds(spark):
    case = CASES[0]
    want = sum(t < 20 * 10**9 for t in walk(*case, 50_000))
    assert load.ramp_lines(spark, *case, t0_ms=0, seconds=20).count() == want == 1_014
    with pytest.raises(ValueError):
        load.ramp_lines(spark, *case, t0_ms=0)


def test_a_long_step_is_the_work_of_many_tasks(spark):
    sent = load.sent_table(spark, load.constant_steps(3), 10**9)
    assert sent.rdd.getNumPartitions() >= 100
    assert sent.where("seq % 250000000 = 1").where(F.col("sent_ns") != 3 * F.col("seq")).isEmpty()


def test_many_steps_need_no_python(spark):
    steps = load.ramp_steps(1_000_000_000, 1_000, 1, 0.1)
    plan = spark.range(9).select(load.sent_ns("id", steps))._jdf.queryExecution().executedPlan().toString()
    assert len(steps) > load.STEPS_IN_SQL and "Python" not in plan and "InPandas" not in plan
    with pytest.raises(ValueError, match="ramp_lines"):
        load.sent_ns("id", steps * (load.STEPS_IN_ARRAYS // len(steps) + 1))
