"""Odd and even records: filters, labels, and the labelled union of both."""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Labels(NamedTuple):
    odd: str
    even: str


# The keys of the windowed-mean and of the throughput query.
MEAN_LABELS = Labels(odd="odd", even="even")
THROUGHPUT_LABELS = Labels(odd="odd0000", even="even1111")


def filter_odd(df: DataFrame) -> DataFrame:
    """Records whose `seq` leaves a remainder; -3 is odd."""
    return df.where(F.col("seq") % 2 != 0)


def filter_even(df: DataFrame) -> DataFrame:
    return df.where(F.col("seq") % 2 == 0)


def label(df: DataFrame, key: str) -> DataFrame:
    """Attach a constant key to every record."""
    return df.withColumn("parity", F.lit(key))


def label_union(df: DataFrame, labels: Labels = MEAN_LABELS) -> DataFrame:
    """Filter, label and union the two halves.

    This reads the source once per branch. `with_parity` gives the same rows from one read.
    """
    return (df.transform(filter_odd).transform(label, labels.odd)
              .unionByName(df.transform(filter_even).transform(label, labels.even)))


def with_parity(df: DataFrame, labels: Labels = MEAN_LABELS) -> DataFrame:
    """Label every record in one pass; records without a `seq` belong to neither half."""
    return df.where(F.col("seq").isNotNull()).withColumn(
        "parity", F.when(F.col("seq") % 2 != 0, labels.odd).otherwise(labels.even))


def key_by_parity(df: DataFrame) -> DataFrame:
    """Records as key and value: `parity`, `value STRUCT<line, n>`.

    This only changes the shape. Moving rows to their key would put half of them in one
    task; grouping moves them after they are combined within each task.
    """
    return df.select("parity", F.struct("line", "n").alias("value"))


def share(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep the records on the executors for several branches, so that all see the same.

    With MEMORY_ONLY, what does not fit is computed again. Unpersist it when the branches
    are done.
    """
    return df.persist(level)
