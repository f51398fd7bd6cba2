"""Generated load: a constant pace, and a pace that quickens step by step."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.functions.exact import div
from streamlat.functions.lines import format_result

NS_PER_MS = 1_000_000
NS_PER_S = 1_000_000_000
# Steps that are looked up in generated code; more go through a binary search over constant arrays.
STEPS_IN_SQL = 64
# Steps of such arrays; loads with more are made by `ramp_lines`, from a table of steps.
STEPS_IN_ARRAYS = 200_000
# Records that a part of a step has at most when it is made on its own.
PART = 1 << 16


class Step(NamedTuple):
    """A stretch of constant pace: record `first_seq + i` is sent at `start_ns + i * delay_ns`."""

    first_seq: int
    start_ns: int
    delay_ns: int


def rate_lines(spark: SparkSession, rows_per_second: int, *,
               partitions: int | None = None) -> DataFrame:
    """Stream of lines at a constant rate, stamped with the time they are made."""
    reader = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    if partitions is not None:
        reader = reader.option("numPartitions", partitions)
    return reader.load().select(
        format_result(F.col("value"), F.unix_millis("timestamp")).alias("line"))


def constant_steps(delay_ns: int) -> list[Step]:
    """One record every `delay_ns`; 0 sends them all at once."""
    return [Step(0, 0, delay_ns)]


def ramp_steps(start_ns: int, min_ns: int, step_s: int, percent: float, *,
               records: int | None = None, seconds: int | None = None) -> list[Step]:
    """Paces of a load that starts with `start_ns` between records and quickens.

    A step ends with the first record sent more than `step_s` seconds after its first.
    That record starts the next step, with the delay cut by `percent` and to whole
    nanoseconds. The last step has a delay of `min_ns` or less, or one that the cut no longer
    changes, and does not end. With `records` or `seconds` no step is made that begins after them.
    """
    steps = [Step(0, 0, start_ns)]
    while steps[-1].delay_ns > min_ns and percent > 0:
        seq, start, delay = steps[-1]
        sent, less = step_s * NS_PER_S // delay + 1, int(delay - delay * (percent / 100))
        following = Step(seq + sent, start + sent * delay, less)
        if (less == delay or records is not None and following.first_seq >= records
                or seconds is not None and following.start_ns >= seconds * NS_PER_S):
            break
        steps.append(following)
    return steps


def records_within(steps: list[Step], total_s: int) -> int:
    """How many records are sent in the first `total_s` seconds."""
    end = total_s * NS_PER_S
    last = [step for step in steps if step.start_ns < end][-1]
    if last.delay_ns == 0:
        raise ValueError("a load without delay sends records without end")
    return last.first_seq + (end - last.start_ns + last.delay_ns - 1) // last.delay_ns


def _step_sql(seq: str, steps: list[Step], low: int, high: int) -> str:
    # Nested halves, so a record is compared with log2(steps) bounds and not with all.
    if low == high:
        return str(low)
    middle = (low + high + 1) // 2
    return (f"IF({seq} < {steps[middle].first_seq}L, "
            f"{_step_sql(seq, steps, low, middle - 1)}, {_step_sql(seq, steps, middle, high)})")


def _found(seq: str, steps: list[Step]) -> str:
    """SQL for the same by binary search, for ramps of many steps."""
    first, start, delay = (f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)"
                           for values in zip(*steps))
    halves = ", ".join(str(1 << k) for k in reversed(range(len(steps).bit_length())))
    step = (f"aggregate(array({halves}), 0, (at, half) -> "
            f"IF(get({first}, at + half) <= {seq}, at + half, at))")
    return (f"transform(array({step}), at -> get({start}, at) "
            f"+ ({seq} - get({first}, at)) * get({delay}, at))[0]")


def sent_ns(seq: str, steps: list[Step]) -> Column:
    """When the record numbered by column `seq` is sent, in nanoseconds after the start."""
    if len(steps) == 1:
        return F.expr(f"{seq} * {steps[0].delay_ns}L")
    if len(steps) > STEPS_IN_ARRAYS:
        raise ValueError(f"{len(steps)} steps; use ramp_lines, or ask for fewer records or seconds")
    if len(steps) > STEPS_IN_SQL:
        return F.expr(_found(seq, steps))
    number = _step_sql(seq, steps, 0, len(steps) - 1)
    first, start, delay = (f"array({', '.join(f'{value}L' for value in values)})[{number}]"
                           for values in zip(*steps))
    return F.expr(f"{start} + ({seq} - {first}) * {delay}")


def sent_table(spark: SparkSession, steps: list[Step], records: int, *, partitions: int | None = None) -> DataFrame:
    """`seq` and `sent_ns` of the first `records` records.

    A row for each step is cut into parts of at most `PART` records, which are dealt out before their records
    are made, so a long step is the work of many tasks.
    """
    known = [step for step in steps if step.first_seq < records]
    ends = [step.first_seq for step in known[1:]] + [records]
    rows = spark.createDataFrame([(*step, end - step.first_seq) for step, end in zip(known, ends)],
                                 "first_seq long, start_ns long, delay_ns long, n long")
    part = F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("n") - 1, F.lit(PART))))
    parts = rows.select("*", part.alias("part")).select(
        "first_seq", "start_ns", "delay_ns", (F.col("part") * PART).alias("low"),
        F.least(F.col("n"), (F.col("part") + 1) * PART).alias("high"))
    width = partitions or max(spark.sparkContext.defaultParallelism, records // (100 * PART))
    turn = F.explode(F.sequence("low", F.col("high") - 1))
    return (parts.repartition(width, "first_seq", "low").select("*", turn.alias("turn"))
            .select((F.col("first_seq") + F.col("turn")).alias("seq"),
                    (F.col("start_ns") + F.col("turn") * F.col("delay_ns")).alias("sent_ns")))


def ramp_lines(spark: SparkSession, start_ns: int, min_ns: int, step_s: int, percent: float, *, t0_ms: int,
               records: int | None = None, seconds: int | None = None,
               partitions: int | None = None) -> DataFrame:
    """Lines of a ramp, for its first `records` records or its first `seconds` seconds.

    Steps are made up to there and no further; none has fewer than one record.
    """
    if (records is None) == (seconds is None):
        raise ValueError("give either records or seconds")
    steps = ramp_steps(start_ns, min_ns, step_s, percent, records=records, seconds=seconds)
    sent = sent_table(spark, steps, records_within(steps, seconds) if records is None else records,
                      partitions=partitions)
    created = t0_ms + div(F.col("sent_ns"), F.lit(NS_PER_MS))
    return sent.select(format_result(F.col("seq"), created).alias("line"))


def replayable_lines(spark: SparkSession, rows_per_batch: int, steps: list[Step], t0_ms: int, *,
                     partitions: int | None = None) -> DataFrame:
    """Stream of a paced load with `rows_per_batch` lines a batch; the same lines in each run."""
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
    if partitions is not None:
        reader = reader.option("numPartitions", partitions)
    return paced_lines(reader.load().select(F.col("value").alias("seq")), steps, t0_ms)


def paced(df: DataFrame, steps: list[Step], t0_ms: int) -> DataFrame:
    """Add `created_ms` to records with `seq` (from 0): when the load sends them."""
    return df.withColumn(
        "created_ms", t0_ms + div(sent_ns("seq", steps), F.lit(NS_PER_MS)))


def paced_lines(df: DataFrame, steps: list[Step], t0_ms: int) -> DataFrame:
    """Lines of a paced load for records with `seq`."""
    return paced(df, steps, t0_ms).select(
        format_result(F.col("seq"), F.col("created_ms")).alias("line"))


def load_lines(spark: SparkSession, records: int, steps: list[Step], t0_ms: int,
               *, partitions: int | None = None) -> DataFrame:
    """A load of `records` lines, made on the executors."""
    return paced_lines(spark.range(0, records, 1, partitions).toDF("seq"), steps, t0_ms)
