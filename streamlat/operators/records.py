"""Messages to lines, lines to typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlat.functions import digits, lines


def message_lines(messages: DataFrame) -> DataFrame:
    """`value BINARY` of messages to `line STRING`."""
    return messages.select(lines.record_value(F.col("value")).alias("line"))


def parse_lines(df: DataFrame, *, lenient: bool = False) -> DataFrame:
    """Add `seq` and `created_ms` to a frame with `line`.

    Strict parsing stops the query at the first bad line. Lenient parsing leaves out
    records that do not parse; `rejected_lines` gives exactly those.
    """
    line = F.col("line")
    seq = lines.parse_seq(line, lenient=lenient).alias("seq")
    created_ms = lines.parse_created_ms(line, lenient=lenient).alias("created_ms")
    if not lenient:
        return df.select("*", seq, created_ms)
    # A filter on plain columns would be pushed below them and parse each line again;
    # it is not pushed below a generator.
    parsed = df.select("*", F.inline(F.array(F.struct(seq, created_ms))))
    return parsed.where(F.col("seq").isNotNull() & F.col("created_ms").isNotNull())


def judged_lines(df: DataFrame) -> DataFrame:
    """All lines with `seq` and `created_ms`, NULL where they do not parse, and whether both are there."""
    line = F.col("line")
    seq, created_ms = lines.parse_seq(line, lenient=True), lines.parse_created_ms(line, lenient=True)
    # Behind a generator no later filter parses the line again.
    parsed = df.select("*", F.inline(F.array(F.struct(seq.alias("seq"), created_ms.alias("created_ms")))))
    return parsed.withColumn("accepted", F.col("seq").isNotNull() & F.col("created_ms").isNotNull())


def rejected_lines(df: DataFrame) -> DataFrame:
    """The lines lenient parsing leaves out."""
    line = F.col("line")
    return df.where(lines.parse_seq(line, lenient=True).isNull()
                    | lines.parse_created_ms(line, lenient=True).isNull())


def append_digit_sum(df: DataFrame) -> DataFrame:
    """Append the digit sum of the whole line to it as a further field."""
    return df.withColumn("line", lines.format_result(F.col("line"), digits.digit_sum("line")))


def cut_fields(df: DataFrame, n: int = 2) -> DataFrame:
    """Cut every line back to its first `n` fields."""
    return df.withColumn("line", lines.keep_fields(F.col("line"), n))


def with_digit_sum(df: DataFrame) -> DataFrame:
    """Add `digit_sum` to parsed records, counting the whole line."""
    # Spark computes a column that is used many times once, below its uses; written
    # inline, the further fields would be cut out again for each of them.
    return (df.withColumn("further", digits.further_fields("line"))
              .withColumn("digit_sum", digits.digit_sum_record("seq", "created_ms", "further"))
              .drop("further"))


def unit_count(df: DataFrame) -> DataFrame:
    """Attach the count 1 to each record."""
    return df.withColumn("n", F.lit(1))


def rescale(df: DataFrame, partitions: int) -> DataFrame:
    """Spread rows evenly over `partitions` tasks, whatever the source gave."""
    return df.repartition(partitions)
