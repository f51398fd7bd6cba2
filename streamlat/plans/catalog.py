"""Every operator and query over whole tables, each with the SQL that must give the same.

`now` is a fixed instant here, so that results can be compared. A query takes the
session and the folder with the tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.functions import clock
from streamlat.functions.digits import digit_sum
from streamlat.functions.lines import format_result
from streamlat.operators import latency, parity, records, sketches, windows
from streamlat.plans import measured
from streamlat.plans.parity_windows import parity_mean, throughput, window_results
from streamlat.plans.record_latency import record_latency
from streamlat.session import apply_settings, new_dir
from streamlat.sinks import files as file_sinks
from streamlat.sinks.kafka import kafka_rows
from streamlat.sources import load, tables
from streamlat.sources.files import text_lines
from streamlat.sources.kafka import result_lines
from streamlat.streaming.clock_windows import clock_window_sums
from streamlat.streaming.run import replay, run_batches, start
from streamlat.streaming.state import open_windows
from streamlat.streaming.timer_windows import timer_window_sums

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = 1706745600000  # 2024-02-01 UTC, after the last event
LOAD_START = 1700000000000
PACE_NS = 20_000_123  # about fifty records a second, and never a whole millisecond
WIDE_WINDOW = "6 hours"

# The ramp: 50 ms between records, down to 20 ms, by 25 percent every 2 s.
RAMP = {"start_ns": 50_000_000, "min_ns": 20_000_000, "step_s": 2, "percent": 25}
UNEVEN_RAMP = {"start_ns": 50_000_000, "min_ns": 1_000_000, "step_s": 2, "percent": 33.7}

# Typed lines of the events table.
LINES = """lines AS (
    SELECT event_id AS seq, epoch_us(ts) // 1000 AS created_ms,
           event_id || ' ' || (epoch_us(ts) // 1000) AS line, event_type, props
    FROM events)"""

PARITY = "CASE WHEN {seq} % 2 <> 0 THEN '{odd}' ELSE '{even}' END"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query under `name`; `sql` may use the `lines` view defined above."""
    def enter(query: Query) -> Query:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return query(apply_settings(spark), directory)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip() if "WITH " in sql else f"WITH {LINES}\n{sql.strip()}"
        return query

    return enter


def _lines(spark: SparkSession, directory: str, *keep: str) -> DataFrame:
    return tables.event_lines(tables.table(spark, directory, "events"), *keep)


def _records(spark: SparkSession, directory: str) -> DataFrame:
    return _lines(spark, directory).transform(records.parse_lines)


def _now():
    return clock.fixed(NOW)


# --- lines -------------------------------------------------------------------------


@register("record_value", "SELECT line FROM lines")
def _(spark, directory):
    return _lines(spark, directory).transform(tables.as_messages).transform(records.message_lines)


@register("parse_line", "SELECT line, seq, created_ms FROM lines")
def _(spark, directory):
    return _records(spark, directory)


def _mixed_lines(spark: SparkSession, directory: str) -> DataFrame:
    # Two of the five event types keep a good line; the others lose the second field,
    # get a second blank, or a carriage return at the end.
    base, kind = _lines(spark, directory, "event_type"), F.col("event_type")
    line, seq = F.col("line"), F.split_part("line", F.lit(" "), F.lit(1))
    return base.select(
        F.when(kind == "error", seq)
         .when(kind == "view", F.replace(line, F.lit(" "), F.lit("  ")))
         .when(kind == "signup", F.concat(line, F.lit("\r")))
         .when(kind == "purchase", F.concat(F.lit("+"), line, F.lit(" x")))
         .otherwise(line).alias("line"))


@register("parse_line_lenient", """
SELECT seq, created_ms FROM lines WHERE event_type NOT IN ('error', 'view', 'signup')""")
def _(spark, directory):
    return (_mixed_lines(spark, directory).transform(records.parse_lines, lenient=True)
            .select("seq", "created_ms"))


@register("rejected_lines", """
SELECT CASE event_type WHEN 'error' THEN CAST(seq AS VARCHAR)
                       WHEN 'view' THEN seq || '  ' || created_ms
                       ELSE line || chr(13) END AS line
FROM lines WHERE event_type IN ('error', 'view', 'signup')""")
def _(spark, directory):
    return _mixed_lines(spark, directory).transform(records.rejected_lines)


_DIGITS = ("CAST(coalesce(list_sum(list_transform(regexp_extract_all({text}, '[0-9]'), "
           "lambda d: CAST(d AS BIGINT))), 0) AS BIGINT)")


@register("digit_sum", f"SELECT line || ' ' || {_DIGITS.format(text='line')} AS line FROM lines")
def _(spark, directory):
    return _lines(spark, directory).transform(records.append_digit_sum)


@register("digit_sum_documents",
          f"SELECT doc_id, {_DIGITS.format(text='text')} AS digit_sum FROM documents")
def _(spark, directory):
    return tables.table(spark, directory, "documents").select(
        "doc_id", digit_sum("text", sparse=True).alias("digit_sum"))


@register("digit_sum_record", f"""
SELECT seq, {_DIGITS.format(text="line || ' ' || props")} AS digit_sum FROM lines""")
def _(spark, directory):
    lines = _lines(spark, directory, "props").select(
        format_result(F.col("line"), F.col("props")).alias("line"))
    return (lines.transform(records.parse_lines).transform(records.with_digit_sum)
            .select("seq", "digit_sum"))


@register("keep_fields", "SELECT line FROM lines")
def _(spark, directory):
    return (_lines(spark, directory).transform(records.append_digit_sum)
            .transform(records.cut_fields, 2))


@register("unit_count", "SELECT line, 1 AS n FROM lines")
def _(spark, directory):
    return _lines(spark, directory).transform(records.unit_count)


@register("rescale", "SELECT line FROM lines")
def _(spark, directory):
    return _lines(spark, directory).transform(
        records.rescale, spark.sparkContext.defaultParallelism)


@register("format_result", "SELECT seq || ' ' || created_ms || chr(10) AS line FROM lines")
def _(spark, directory):
    return _records(spark, directory).select(
        format_result(F.col("seq"), F.col("created_ms"), newline=True).alias("line"))


# --- odd and even ------------------------------------------------------------------


@register("filter_odd", "SELECT seq, created_ms FROM lines WHERE seq % 2 <> 0")
def _(spark, directory):
    return _records(spark, directory).transform(parity.filter_odd).select("seq", "created_ms")


@register("filter_even", "SELECT seq, created_ms FROM lines WHERE seq % 2 = 0")
def _(spark, directory):
    return _records(spark, directory).transform(parity.filter_even).select("seq", "created_ms")


@register("label_odd", "SELECT line, 'odd' AS parity FROM lines WHERE seq % 2 <> 0")
def _(spark, directory):
    return (_records(spark, directory).transform(parity.filter_odd)
            .transform(parity.label, parity.MEAN_LABELS.odd).select("line", "parity"))


@register("label_even", "SELECT line, 'even' AS parity FROM lines WHERE seq % 2 = 0")
def _(spark, directory):
    return (_records(spark, directory).transform(parity.filter_even)
            .transform(parity.label, parity.MEAN_LABELS.even).select("line", "parity"))


def _labelled_sql(odd: str, even: str) -> str:
    label = PARITY.format(seq="seq", odd=odd, even=even)
    return f"SELECT seq, created_ms, {label} AS parity FROM lines"


@register("label_union", _labelled_sql("odd", "even"))
def _(spark, directory):
    return (_records(spark, directory).transform(parity.label_union)
            .select("seq", "created_ms", "parity"))


@register("parity_fused", _labelled_sql("odd", "even"))
def _(spark, directory):
    return (_records(spark, directory).transform(parity.with_parity)
            .select("seq", "created_ms", "parity"))


@register("parity_fused_throughput_labels", _labelled_sql("odd0000", "even1111"))
def _(spark, directory):
    return (_records(spark, directory)
            .transform(parity.with_parity, parity.THROUGHPUT_LABELS)
            .select("seq", "created_ms", "parity"))


@register("key_by_parity", f"""
SELECT {PARITY.format(seq="seq", odd="odd", even="even")} AS parity, line, 1 AS n FROM lines""")
def _(spark, directory):
    return (_records(spark, directory).transform(records.unit_count)
            .transform(parity.with_parity).transform(parity.key_by_parity)
            .select("parity", "value.line", "value.n"))


# --- windows -----------------------------------------------------------------------


def _window_sql(columns: str, *, width_ms: int, source: str = "lines", where: str = "",
                odd: str = "odd", even: str = "even") -> str:
    """`columns` over n, avg_created_ms, sums, of each window and parity of `source`."""
    return f"""
SELECT {columns} FROM (
    SELECT created_ms - created_ms % {width_ms} AS window_start_ms,
           {PARITY.format(seq="seq", odd=odd, even=even)} AS parity,
           count(*) AS n, sum(seq) AS sum_seq, sum(created_ms) AS sum_created_ms,
           CAST(sum(created_ms) // count(*) AS BIGINT) AS avg_created_ms,
           CAST(sum({_DIGITS.format(text="line")}) AS BIGINT) AS sum_digit_sum
    FROM {source} GROUP BY ALL) AS w {where}"""


SUMS = "window_start_ms, parity, n, sum_seq || ' ' || sum_created_ms AS line"
MEANS = "window_start_ms, parity, n, avg_created_ms"
RESULTS = (f"{MEANS}, {NOW} AS emitted_ms, {NOW} - avg_created_ms AS latency_ms, "
           f"n || ' ' || avg_created_ms || ' ' || {NOW} || ' ' || ({NOW} - avg_created_ms)"
           " AS result")
PORT_RESULTS = RESULTS.replace(" AS result", " || chr(10) AS result")
LOADED_RESULTS = RESULTS + ", sum_digit_sum"

RESULT_COLUMNS = ["window_start_ms", "parity", "n", "avg_created_ms", "emitted_ms",
                  "latency_ms", "result"]
SIX_HOURS, TWO_SECONDS, TEN_SECONDS = 21_600_000, 2_000, 10_000
THROUGHPUT = {"odd": "odd0000", "even": "even1111"}


@register("window_sums", _window_sql(SUMS, width_ms=SIX_HOURS))
def _(spark, directory):
    return (_records(spark, directory).transform(parity.with_parity)
            .transform(windows.window_sums, WIDE_WINDOW).transform(windows.partial_line)
            .select("window_start_ms", "parity", "n", "line"))


@register("window_mean", _window_sql(MEANS, width_ms=SIX_HOURS))
def _(spark, directory):
    return (_records(spark, directory).transform(parity.with_parity)
            .transform(windows.window_sums, WIDE_WINDOW).transform(windows.window_mean)
            .select("window_start_ms", "parity", "n", "avg_created_ms"))


@register("arrival_windows", f"""
SELECT {PARITY.format(seq="seq", odd="odd", even="even")} AS parity, count(*) AS n,
       CAST(sum(created_ms) AS VARCHAR) AS sum_created_ms, TRUE AS aligned
FROM lines GROUP BY ALL""")
def _(spark, directory):
    # All rows of a batch query arrive in one window; which one is up to the clock.
    return (_records(spark, directory).transform(parity.with_parity)
            .transform(windows.window_sums, "2 seconds", time=windows.arrival_time())
            .select("parity", "n", F.col("sum_created_ms").cast("string"),
                    (F.col("window_start_ms") % 2_000 == 0).alias("aligned")))


# --- latency -----------------------------------------------------------------------

_RECORD_SQL = (f"SELECT seq, created_ms, {NOW} AS processed_ms, {NOW} - created_ms AS latency_ms, "
               f"{{line}} || ' ' || {NOW} || ' ' || ({NOW} - created_ms){{end}} AS result FROM lines")


@register("stamp_latency", f"""
SELECT seq, {NOW} AS processed_ms, {NOW} - created_ms AS latency_ms FROM lines""")
def _(spark, directory):
    return (_records(spark, directory).transform(latency.stamp_latency, _now())
            .select("seq", "processed_ms", "latency_ms"))


@register("stamp_latency_clocks", """
SELECT count(*) AS n, count(*) AS consistent, 1 AS batch_instants FROM lines""")
def _(spark, directory):
    per_row = F.col("row_ms") - F.col("created_ms") == F.col("latency_ms")
    return (_records(spark, directory)
            .withColumn("batch_ms", clock.per_batch())
            .transform(latency.stamp_latency, clock.per_row(), stamp="row_ms")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(per_row).alias("consistent"),
                 F.when(F.min("batch_ms") == F.max("batch_ms"), 1).alias("batch_instants")))


# Result lines as they come back: from a topic with the broker's stamp, from a socket at
# an arrival time. Both delays depend on the event.
@register("broker_latency", f"""
SELECT created_ms, {NOW} + seq % 1000 AS broker_ms,
       {NOW} + seq % 1000 - created_ms AS diff_ms,
       line || ' ' || {NOW} || ' ' || ({NOW} - created_ms) || ' ' || ({NOW} + seq % 1000)
            || ' ' || ({NOW} + seq % 1000 - created_ms) AS measured
FROM lines""")
def _(spark, directory):
    seq = F.split_part(F.col("value").cast("string"), F.lit(" "), F.lit(1)).cast("long")
    sent = kafka_rows(record_latency(_lines(spark, directory), now=_now()))
    messages = sent.select(F.col("value").cast("binary").alias("value"),
                           F.timestamp_millis(NOW + seq % 1000).alias("timestamp"))
    return messages.transform(result_lines).transform(measured.topic_results)


@register("port_latency", f"""
SELECT created_ms, {NOW} AS processed_ms, {NOW} + 50 + seq % 700 AS arrival_ms,
       {NOW} + 50 + seq % 700 - created_ms AS e2e_ms, 50 + seq % 700 AS sink_leg_ms,
       line || ' ' || {NOW} || ' ' || ({NOW} - created_ms) || ' ' || ({NOW} + 50 + seq % 700)
            || ' ' || ({NOW} + 50 + seq % 700 - created_ms) || ' ' || (50 + seq % 700) AS measured
FROM lines""")
def _(spark, directory):
    results = record_latency(_lines(spark, directory), now=_now())
    received = results.select(F.col("result").alias("line"), "seq")
    return received.transform(measured.port_results, arrival=NOW + 50 + F.col("seq") % 700)


# --- generated load ----------------------------------------------------------------


def _constant_load(spark: SparkSession, directory: str) -> DataFrame:
    seqs = tables.table(spark, directory, "events").select(F.col("event_id").alias("seq"))
    return load.paced_lines(seqs, load.constant_steps(PACE_NS), LOAD_START)


LOAD = f"""WITH load AS (
    SELECT event_id AS seq, {LOAD_START} + event_id * {PACE_NS} // 1000000 AS created_ms,
           event_id || ' ' || ({LOAD_START} + event_id * {PACE_NS} // 1000000) AS line
    FROM events)"""


@register("constant_rate", f"{LOAD} SELECT line FROM load")
def _(spark, directory):
    return _constant_load(spark, directory)


# The oracle walks the load record by record: the record that crosses the end of a step
# is sent, then the delay drops.
def _ramp_sql(start_ns: int, min_ns: int, step_s: int, percent: float) -> str:
    return f"""
WITH RECURSIVE walk(seq, sent_ns, step_ns, delay_ns) AS (
    SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, {start_ns}::BIGINT
    UNION ALL
    SELECT seq + 1, sent_ns + next_delay, CASE WHEN cut THEN sent_ns ELSE step_ns END, next_delay
    FROM (SELECT *, CASE WHEN cut
                         THEN CAST(trunc(delay_ns - delay_ns * CAST('{percent / 100!r}' AS DOUBLE)) AS BIGINT)
                         ELSE delay_ns END AS next_delay
          FROM (SELECT *, delay_ns > {min_ns}
                          AND sent_ns - step_ns > {step_s} * 1000000000 AS cut FROM walk))
    WHERE seq < (SELECT max(event_id) FROM events))
SELECT seq || ' ' || ({LOAD_START} + sent_ns // 1000000) AS line
FROM walk JOIN events ON event_id = seq"""


def _ramp_load(spark: SparkSession, directory: str, ramp: dict) -> DataFrame:
    seqs = tables.table(spark, directory, "events").select(F.col("event_id").alias("seq"))
    return load.paced_lines(seqs, load.ramp_steps(**ramp), LOAD_START)


@register("ramp_schedule", _ramp_sql(**RAMP))
def _(spark, directory):
    return _ramp_load(spark, directory, RAMP)


# A percentage for which dividing late would be off by a nanosecond in each later record.
@register("ramp_schedule_uneven", _ramp_sql(**UNEVEN_RAMP))
def _(spark, directory):
    return _ramp_load(spark, directory, UNEVEN_RAMP)


# As a table of steps, long ones in parts, and one with a step for nearly each record.
FINE_RAMP = {"start_ns": 10_000_000, "min_ns": 1_000, "step_s": 0, "percent": 0.00001}


def _ramp_table(spark: SparkSession, directory: str, ramp: dict) -> DataFrame:
    records = tables.table(spark, directory, "events").count()
    return load.ramp_lines(spark, **ramp, t0_ms=LOAD_START, records=records)


@register("ramp_table", _ramp_sql(**UNEVEN_RAMP))
def _(spark, directory):
    return _ramp_table(spark, directory, UNEVEN_RAMP)


@register("ramp_table_fine", _ramp_sql(**FINE_RAMP))
def _(spark, directory):
    return _ramp_table(spark, directory, FINE_RAMP)


# --- quantiles of latency ----------------------------------------------------------

# A sketch's quantile may be off by this share of the rows of its window, and one row.
RANK_ERROR = 0.03
NEAR = ", ".join(f"TRUE AS p{q * 100:g}_near" for q in sketches.QUANTILES)


def _stamped(lines: DataFrame) -> DataFrame:
    return (lines.transform(records.parse_lines).transform(parity.with_parity)
            .transform(latency.stamp_latency, _now()))


def _near(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Whether the true ranks of each window's quantiles are within the bound."""
    names = [f"p{q * 100:g}" for q in sketches.QUANTILES]
    start = F.unix_millis(F.window(windows.created_time(), WIDE_WINDOW)["start"]).alias("window_start_ms")
    rows = exact.select(start, "parity", "latency_ms").join(
        found.withColumnRenamed("n", "rows"), ["window_start_ms", "parity"])
    slack = RANK_ERROR * F.col("n") + 1
    counted = rows.groupBy("window_start_ms", "parity").agg(
        F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows"),
        *[F.count_if(F.col("latency_ms") < F.col(p)).alias(f"{p}_below") for p in names],
        *[F.count_if(F.col("latency_ms") <= F.col(p)).alias(f"{p}_to") for p in names])
    return counted.select("window_start_ms", "parity", F.col("rows").alias("n"), *[
        ((F.col(f"{p}_below") - slack <= q * F.col("n")) & (q * F.col("n") <= F.col(f"{p}_to") + slack))
        .alias(f"{p}_near") for p, q in zip(names, sketches.QUANTILES)])


# Sketches of hours, put together to windows of six hours.
@register("latency_quantiles", _window_sql(f"window_start_ms, parity, n, {NEAR}", width_ms=SIX_HOURS))
def _(spark, directory):
    stamped = _stamped(_lines(spark, directory))
    hours = sketches.latency_sketches(stamped, "1 hour")
    return _near(sketches.quantiles(sketches.wider(hours, SIX_HOURS)), stamped)


# --- the five queries --------------------------------------------------------------


@register("record_latency_kafka", _RECORD_SQL.format(line="line", end=""))
def _(spark, directory):
    messages = _lines(spark, directory).transform(tables.as_messages)
    return record_latency(messages.transform(records.message_lines), now=_now())


@register("record_latency_port", _RECORD_SQL.format(line="line", end=" || chr(10)"))
def _(spark, directory):
    return record_latency(_lines(spark, directory), now=_now(), newline=True)


@register("record_latency_further_fields",
          _RECORD_SQL.format(line="line || ' ' || props", end=""))
def _(spark, directory):
    lines = _lines(spark, directory, "props").select(
        format_result(F.col("line"), F.col("props")).alias("line"))
    return record_latency(lines, now=_now())


@register("parity_mean_kafka_2s", _window_sql(RESULTS, width_ms=TWO_SECONDS))
def _(spark, directory):
    messages = _lines(spark, directory).transform(tables.as_messages)
    return parity_mean(messages.transform(records.message_lines), now=_now()).select(RESULT_COLUMNS)


@register("parity_mean_port_2s", _window_sql(PORT_RESULTS, width_ms=TWO_SECONDS))
def _(spark, directory):
    return parity_mean(_lines(spark, directory), now=_now(), newline=True).select(RESULT_COLUMNS)


@register("parity_mean_6h", _window_sql(RESULTS, width_ms=SIX_HOURS))
def _(spark, directory):
    return parity_mean(_lines(spark, directory), width=WIDE_WINDOW, now=_now()).select(RESULT_COLUMNS)


# Windows counted from 700 ms after a full second, as by a job that began then.
@register("parity_mean_from_start_2s", f"""
SELECT created_ms - (created_ms - 700) % 2000 AS window_start_ms,
       {PARITY.format(seq="seq", odd="odd", even="even")} AS parity, count(*) AS n,
       CAST(sum(seq) AS VARCHAR) AS sum_seq, CAST(sum(created_ms) AS VARCHAR) AS sum_created_ms
FROM lines GROUP BY ALL""")
def _(spark, directory):
    sums = (_records(spark, directory).transform(parity.with_parity)
            .transform(windows.window_sums, "2 seconds", start_ms=LOAD_START + 700))
    return sums.select("window_start_ms", "parity", "n", F.col("sum_seq").cast("string"),
                       F.col("sum_created_ms").cast("string"))


@register("parity_mean_two_branch_6h", _window_sql(RESULTS, width_ms=SIX_HOURS))
def _(spark, directory):
    return (_records(spark, directory).transform(parity.label_union)
            .transform(windows.window_sums, WIDE_WINDOW)
            .transform(window_results, now=_now()).select(RESULT_COLUMNS))


@register("parity_mean_load_2s",
          LOAD + _window_sql(RESULTS, width_ms=TWO_SECONDS, source="load"))
def _(spark, directory):
    return parity_mean(_constant_load(spark, directory), now=_now()).select(RESULT_COLUMNS)


@register("throughput_10s", _window_sql(LOADED_RESULTS, width_ms=TEN_SECONDS, **THROUGHPUT))
def _(spark, directory):
    return throughput(_lines(spark, directory), now=_now()).select(
        *RESULT_COLUMNS, "sum_digit_sum")


@register("throughput_load_10s",
          LOAD + _window_sql(LOADED_RESULTS, width_ms=TEN_SECONDS, source="load", **THROUGHPUT))
def _(spark, directory):
    return throughput(_constant_load(spark, directory), now=_now()).select(
        *RESULT_COLUMNS, "sum_digit_sum")


# Order lines by day of shipment: the largest table, and windows with many records.
@register("throughput_lineitem_10s", f"""
WITH shipped AS (
    SELECT l_orderkey * 8 + l_linenumber AS seq, epoch_us(l_shipdate) // 1000 AS created_ms,
           (l_orderkey * 8 + l_linenumber) || ' ' || (epoch_us(l_shipdate) // 1000) AS line
    FROM lineitem)
""" + _window_sql(LOADED_RESULTS, width_ms=TEN_SECONDS, source="shipped", **THROUGHPUT))
def _(spark, directory):
    items = tables.table(spark, directory, "lineitem")
    lines = tables.as_lines(items, F.col("l_orderkey") * 8 + F.col("l_linenumber"),
                            tables.epoch_ms(F.col("l_shipdate")))
    return throughput(lines, now=_now()).select(*RESULT_COLUMNS, "sum_digit_sum")


# --- as streams --------------------------------------------------------------------


def _stream(spark: SparkSession, directory: str) -> DataFrame:
    return tables.event_lines(tables.table_stream(spark, directory, "events"))


# Windows are written while they are open and wait for no later record, so nothing is
# late and every record counts.
def _windows_so_far(spark: SparkSession, results: DataFrame) -> DataFrame:
    path = new_dir(spark, "windows")
    replay(spark, file_sinks.to_window_table(results, path),
           state_partitions=spark.sparkContext.defaultParallelism)
    return file_sinks.latest_windows(spark, path, "window_start_ms", "parity")


def _totals(closed: DataFrame, width_ms: int) -> DataFrame:
    """Records and sums of all windows by parity, and whether each window begins at a multiple of its width."""
    return closed.groupBy("parity").agg(
        F.sum("n").alias("n"),
        F.sum("sum_created_ms").cast("decimal(38,0)").cast("string").alias("sum_created_ms"),
        F.bool_and(F.col("window_start_ms") % width_ms == 0).alias("aligned"))


def _line_files(lines: DataFrame, path: str, files: int = 3) -> None:
    """Add the lines to text files in `path`, ordered by their sequence number."""
    seq = F.split_part("line", F.lit(" "), F.lit(1)).cast("long")
    (lines.withColumn("seq", seq).repartitionByRange(files, "seq").sortWithinPartitions("seq")
     .select("line").write.mode("append").text(path))


def _file_stream(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark, path, streaming=True, max_files_per_trigger=1)


@register("stream_record_latency", _RECORD_SQL.format(line="line", end=""))
def _(spark, directory):
    path = new_dir(spark, "records")
    results = record_latency(_stream(spark, directory), now=_now())
    replay(spark, file_sinks.to_table(results, path))
    return spark.read.parquet(path)


@register("stream_parity_mean_6h", _window_sql(RESULTS, width_ms=SIX_HOURS))
def _(spark, directory):
    results = parity_mean(_stream(spark, directory), width=WIDE_WINDOW, now=_now())
    return _windows_so_far(spark, results.select(RESULT_COLUMNS))


# Appended windows are the closed ones: those that ended by the time of the last record.
@register("stream_parity_mean_closed_6h", _window_sql(
    RESULTS, width_ms=SIX_HOURS,
    where=f"WHERE window_start_ms + {SIX_HOURS} <= (SELECT max(created_ms) FROM lines)"))
def _(spark, directory):
    path = new_dir(spark, "closed")
    results = parity_mean(_stream(spark, directory), width=WIDE_WINDOW, lateness="0 seconds",
                          now=_now())
    replay(spark, file_sinks.to_table(results.select(RESULT_COLUMNS), path),
           state_partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(path)


@register("stream_throughput_10s",
          _window_sql(LOADED_RESULTS, width_ms=TEN_SECONDS, **THROUGHPUT))
def _(spark, directory):
    results = throughput(_stream(spark, directory), now=_now())
    return _windows_so_far(spark, results.select(*RESULT_COLUMNS, "sum_digit_sum"))


@register("stream_arrival_windows", f"""
SELECT {PARITY.format(seq="seq", odd="odd", even="even")} AS parity, count(*) AS n,
       CAST(sum(created_ms) AS VARCHAR) AS sum_created_ms, TRUE AS aligned
FROM lines GROUP BY ALL""")
def _(spark, directory):
    results = parity_mean(_stream(spark, directory), time=windows.arrival_time(),
                          lateness="0 seconds")
    return _totals(_windows_so_far(spark, results), 2_000)


@register("stream_text_files_6h", _window_sql(RESULTS, width_ms=SIX_HOURS))
def _(spark, directory):
    path = new_dir(spark, "lines")
    _lines(spark, directory).write.text(path)
    results = parity_mean(text_lines(spark, path, streaming=True), width=WIDE_WINDOW,
                          now=_now())
    return _windows_so_far(spark, results.select(RESULT_COLUMNS))


@register("stream_text_log", f"""
SELECT line || ' ' || {NOW} || ' ' || ({NOW} - created_ms) AS line FROM lines""")
def _(spark, directory):
    path = new_dir(spark, "log")
    results = record_latency(_stream(spark, directory), now=_now())
    replay(spark, file_sinks.to_text_log(results, path))
    return text_lines(spark, path)


# Started twice with one checkpoint: the second run finds nothing new.
@register("stream_resumed", _RECORD_SQL.format(line="line", end=""))
def _(spark, directory):
    path, checkpoint = new_dir(spark, "records"), new_dir(spark, "checkpoint")
    for _run in range(2):
        results = record_latency(_stream(spark, directory), now=_now())
        replay(spark, file_sinks.to_table(results, path), checkpoint=checkpoint)
    return spark.read.parquet(path)


@register("stream_shared_batch", _labelled_sql("odd", "even"))
def _(spark, directory):
    path = new_dir(spark, "halves")

    def half(name, keep, key):
        def write(batch, batch_id):
            (batch.transform(keep).transform(parity.label, key)
                  .select("seq", "created_ms", "parity")
                  .write.mode("overwrite").parquet(f"{path}/half={name}/batch_id={batch_id}"))
        return write

    stream = _stream(spark, directory).transform(records.parse_lines)
    replay(spark, file_sinks.to_each(
        stream, half(0, parity.filter_odd, parity.MEAN_LABELS.odd),
        half(1, parity.filter_even, parity.MEAN_LABELS.even)))
    return spark.read.parquet(path).select("seq", "created_ms", "parity")


# --- several batches, restarts, the clock ------------------------------------------


# One file a batch, so windows change in several batches.
@register("stream_parity_mean_batches_6h", _window_sql(RESULTS, width_ms=SIX_HOURS))
def _(spark, directory):
    path = new_dir(spark, "lines")
    _line_files(_lines(spark, directory), path, 5)
    results = parity_mean(_file_stream(spark, path), width=WIDE_WINDOW, now=_now())
    return _windows_so_far(spark, results.select(RESULT_COLUMNS))


# Stopped after half of the records: what the state holds then, and the windows after the other half.
@register("stream_open_windows", f"""
WITH {LINES},
early AS (SELECT * FROM lines WHERE seq < (SELECT count(*) // 2 FROM lines))
SELECT 'open' AS phase, * FROM ({_window_sql(SUMS, width_ms=SIX_HOURS, source="early")})
UNION ALL SELECT 'final', * FROM ({_window_sql(SUMS, width_ms=SIX_HOURS)})""")
def _(spark, directory):
    path, checkpoint, out, held = (new_dir(spark, name) for name in ("lines", "checkpoint", "windows", "open"))
    lines = _lines(spark, directory)
    early = F.split_part("line", F.lit(" "), F.lit(1)).cast("long") < F.lit(lines.count() // 2)

    def run():
        results = parity_mean(_file_stream(spark, path), width=WIDE_WINDOW, now=_now())
        replay(spark, file_sinks.to_window_table(results, out), checkpoint=checkpoint, state_partitions=4)

    _line_files(lines.where(early), path)
    run()
    open_windows(spark, checkpoint).write.parquet(held)
    _line_files(lines.where(~early), path)
    run()
    final = file_sinks.latest_windows(spark, out, "window_start_ms", "parity")
    both = [df.transform(windows.partial_line).select(F.lit(phase).alias("phase"), "window_start_ms", "parity", "n", "line")
            for phase, df in (("open", spark.read.parquet(held)), ("final", final))]
    return both[0].union(both[1])


# Stopped after two batches of fixed size, and gone on with to the end.
@register("stream_constant_rate", f"{LOAD} SELECT line FROM load")
def _(spark, directory):
    path, checkpoint = new_dir(spark, "load"), new_dir(spark, "checkpoint")
    wanted = tables.table(spark, directory, "events").count()
    for batches in (2, 5):
        lines = load.replayable_lines(spark, -(-wanted // 5), load.constant_steps(PACE_NS), LOAD_START)
        run_batches(spark, file_sinks.to_table(lines, path), batches, checkpoint=checkpoint)
    # The stream has no end, so it may have begun a further batch.
    return spark.read.parquet(path).where(F.split_part("line", F.lit(" "), F.lit(1)).cast("long") < wanted)


@register("stream_accepted_and_rejected", f"""
SELECT CASE event_type WHEN 'error' THEN CAST(seq AS VARCHAR) WHEN 'view' THEN replace(line, ' ', '  ')
       WHEN 'signup' THEN line || chr(13) WHEN 'purchase' THEN '+' || line || ' x' ELSE line END AS line,
       event_type NOT IN ('error', 'view', 'signup') AS accepted,
       CASE WHEN event_type NOT IN ('error', 'view', 'signup') THEN seq END AS seq FROM lines""")
def _(spark, directory):
    path, good, bad = (new_dir(spark, name) for name in ("lines", "accepted", "rejected"))
    # A line with a carriage return in it would be two in a text file.
    _mixed_lines(spark, directory).repartition(3).write.parquet(path)
    stream = (spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(path))
    replay(spark, file_sinks.to_accepted_and_rejected(stream, good, bad))
    none = F.lit(None).cast("long").alias("seq")
    return (spark.read.parquet(good).select("line", F.lit(True).alias("accepted"), "seq")
            .union(spark.read.parquet(bad).select("line", F.lit(False).alias("accepted"), none)))


@register("stream_latency_quantiles", _window_sql(f"window_start_ms, parity, n, {NEAR}", width_ms=SIX_HOURS))
def _(spark, directory):
    path = new_dir(spark, "lines")
    _line_files(_lines(spark, directory), path)
    made = sketches.latency_sketches(_stamped(_file_stream(spark, path)), WIDE_WINDOW)
    return _near(sketches.quantiles(_windows_so_far(spark, made)), _stamped(_lines(spark, directory)))


def _closed_by_the_clock(spark: SparkSession, directory: str, close: Callable, width_ms: int) -> DataFrame:
    """Totals of windows of arrival that nothing but the clock closes; an error if some do not close."""
    path, out = new_dir(spark, "lines"), new_dir(spark, "closed")
    lines = _lines(spark, directory)
    _line_files(lines, path)
    labelled = _file_stream(spark, path).transform(records.parse_lines).transform(parity.with_parity)
    query = start(spark, file_sinks.to_table(close(labelled), out), interval_ms=200, state_partitions=2)
    wanted, deadline = lines.count(), time.monotonic() + 240
    try:
        while True:
            if query.exception() is not None:
                raise query.exception()
            done = [p.batchId for p in query.recentProgress]
            if done and (closed := spark.read.schema("n long").parquet(out).agg(F.sum("n")).first()[0]) == wanted:
                break
            if time.monotonic() > deadline:
                raise TimeoutError(f"{closed} of {wanted} records are in closed windows")
            time.sleep(0.5)
    finally:
        query.stop()
    return _totals(spark.read.parquet(out), width_ms)


_TOTALS_SQL = f"""
SELECT {PARITY.format(seq="seq", odd="odd", even="even")} AS parity, count(*) AS n,
       CAST(sum(created_ms) AS VARCHAR) AS sum_created_ms, TRUE AS aligned
FROM lines GROUP BY ALL"""


@register("stream_clock_windows", _TOTALS_SQL)
def _(spark, directory):
    return _closed_by_the_clock(spark, directory, lambda df: clock_window_sums(df, "2 seconds"), 2_000)


@register("stream_timer_windows", _TOTALS_SQL)
def _(spark, directory):
    return _closed_by_the_clock(spark, directory, lambda df: timer_window_sums(df, 2_000), 2_000)
