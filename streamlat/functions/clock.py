"""What "now" is, in epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(ms: int) -> Column:
    """A given instant, for replays that must give the same result each time."""
    return F.lit(ms).cast("long")


def per_batch() -> Column:
    """Start of the micro-batch (or batch query), one value for all its rows."""
    return F.unix_millis(F.current_timestamp())


def per_row() -> Column:
    """The executor's wall clock at the moment the row is processed."""
    return F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long")
