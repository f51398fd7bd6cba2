"""What streams report of themselves."""

import json

from streamlat.functions import clock
from streamlat.plans.parity_windows import parity_mean
from streamlat.sinks import files
from streamlat.sources.files import text_lines
from streamlat.streaming.jobs import throughput_results
from streamlat.streaming.progress import PROGRESS, rates, reported
from streamlat.streaming.run import replay


def test_reports_of_three_batches_add_up(spark, lines, tmp_path):
    for i in range(3):
        lines(*(f"{k} {1000 * k}" for k in range(i * 10, i * 10 + 10))).coalesce(1).write.mode("append").text(
            str(tmp_path / "in"))
    path = str(tmp_path / "progress")
    with reported(spark, path, held=2):
        stream = text_lines(spark, str(tmp_path / "in"), streaming=True, max_files_per_trigger=1)
        results = parity_mean(stream, width="1 hour", now=clock.fixed(0))
        replay(spark, files.to_window_table(results, str(tmp_path / "windows")), name="mean", state_partitions=2)
    progress = spark.read.schema(PROGRESS).parquet(path)
    got = progress.where("rows > 0").orderBy("batch_id").collect()
    assert [(r.name, r.batch_id, r.rows) for r in got] == [("mean", 0, 10), ("mean", 1, 10), ("mean", 2, 10)]
    assert all(r.batch_ms > 0 and r.rows_per_second > 0 and r.state_rows == 2 for r in got)
    [rate] = rates(progress).collect()
    assert (rate.rows, rate.batches, rate.most_state_rows) == (30, 3, 2) and rate.rows_per_second > 0


def test_observed_metrics_are_reported(spark, lines, tmp_path):
    lines("12 1000", "5 2000").coalesce(1).write.text(str(tmp_path / "in"))
    path = str(tmp_path / "progress")
    with reported(spark, path):
        stream = text_lines(spark, str(tmp_path / "in"), streaming=True)
        replay(spark, files.to_table(throughput_results(stream, clock_fired=False), str(tmp_path / "out")),
               state_partitions=2)
    observed = [json.loads(r.observed) for r in spark.read.schema(PROGRESS).parquet(path).collect()]
    assert observed and all("throughput" in o for o in observed)
    assert {k for o in observed for k in o["throughput"]} == {"windows", "records", "digit_sum"}
