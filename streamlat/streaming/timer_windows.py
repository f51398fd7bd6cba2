"""Tumbling windows of arrival, each closed by a timer of its own.

The state has an entry for each window and key, with a timer at the window's end. Timers go off with the
first batch after their time, and batches come without records too, so a window needs neither a record
behind it nor a heartbeat beside it. Each task puts its records together before they are sent: a key with half
of all records sends a row a task, a window and an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from streamlat.operators.windows import arrival_time

SUM = "decimal(38,0)"

# An entry goes after this many widths, should its timer be lost.
WIDTHS_KEPT = 1000


class WindowState(StatefulProcessor):
    """Count and sums of one window and key, given out when the window's timer goes off."""

    def __init__(self, sums: tuple[str, ...], width_ms: int):
        self.sums, self.width_ms = sums, width_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "sums", ", ".join(["n bigint", *(f"{name} {SUM}" for name in self.sums)]),
            ttlDurationMs=WIDTHS_KEPT * self.width_ms + 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        total = list(old) if old else [0, *[Decimal(0)] * len(self.sums)]
        for row in rows:
            total = [a + row[name] for a, name in zip(total, ("n", *self.sums))]
        self.state.update(tuple(total))
        if old is None:
            self.handle.registerTimer(key[0])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, *totals = self.state.get()
        self.state.clear()
        yield Row(window_start_ms=key[0] - self.width_ms, parity=key[1], n=n, **dict(zip(self.sums, totals)))

    def close(self) -> None:
        pass


def _together(records: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """Counts and sums of the records of a task by window and key, batch by batch."""
    big = pa.decimal128(38, 0)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in sums:
                at = table.schema.get_field_index(name)
                table = table.set_column(at, name, pc.cast(table.column(name), big))
            made = table.group_by(["window_end_ms", "parity"]).aggregate(
                [([], "count_all"), *((name, "sum") for name in sums)])
            made = made.select(["window_end_ms", "parity", "count_all", *(f"{name}_sum" for name in sums)])
            made = made.rename_columns(["window_end_ms", "parity", "n", *sums])
            yield from made.combine_chunks().to_batches()

    return records.mapInArrow(run, ", ".join(["window_end_ms long, parity string, n long",
                                              *(f"{name} {SUM}" for name in sums)]))


def timer_window_sums(records: DataFrame, width_ms: int, *, totals: tuple[str, ...] = ()) -> DataFrame:
    """`window_sums` by arrival of a stream of labelled records, closed by timers.

    The state must lie in RocksDB. A window that was open when the job stopped comes out after a restart with
    the same checkpoint, together with what still arrives before its end.
    """
    values = ("seq", "created_ms", *totals)
    sums = tuple(f"sum_{name}" for name in values)
    now = F.unix_millis(arrival_time())
    end = (now - F.pmod(now, F.lit(width_ms)) + width_ms).alias("window_end_ms")
    part = records.select(end, "parity", *[F.col(v).cast("long").alias(s) for v, s in zip(values, sums)])
    out = ", ".join(["window_start_ms long, parity string, n long", *(f"{name} {SUM}" for name in sums)])
    closed = _together(part, sums).groupBy("window_end_ms", "parity").transformWithState(
        WindowState(sums, width_ms), out, "append", "ProcessingTime")
    whole = [F.col(f"sum_{name}").cast("long").alias(f"sum_{name}") for name in totals]
    return closed.select("window_start_ms", "parity", "n", "sum_seq", "sum_created_ms", *whole)
