"""Sum of the decimal digits of a line, the per-record CPU load of the throughput query.

The expressions are long and regular, so they are written as SQL over column names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text_sql(text: str) -> str:
    # How many bytes a text loses without a digit is how often the digit occurs. This
    # stays in generated code, where aggregate() over an array of matches does not.
    return " + ".join(f"{digit}L * (octet_length({text}) - octet_length(replace({text}, '{digit}')))"
                      for digit in range(1, 10))


def _number_sql(number: str) -> str:
    # Legendre: n less nine times the sum of n div 10, n div 100, ... is the digit sum
    # of n. Nine times that sum is never larger than n, so nothing overflows.
    quotients = " + ".join(f"{number} div {10**k}L" for k in range(1, 19))
    return f"abs({number} - 9L * ({quotients}))"


def digit_sum(text: str, *, sparse: bool = False) -> Column:
    """Sum of the characters 0-9 of a text column, of any length.

    `sparse` first takes out everything else, which pays for long texts with few digits.
    """
    return F.expr(_text_sql(f"regexp_replace({text}, '[^0-9]+', '')" if sparse else text))


def digit_sum_long(number: str) -> Column:
    """Digit sum of a BIGINT column by arithmetic; the sign does not count."""
    return F.expr(_number_sql(number))


def further_fields(line: str) -> Column:
    """What follows the first two fields of a line, mostly nothing."""
    return F.expr(f"substr({line}, length(substring_index({line}, ' ', 2)) + 1)")


def digit_sum_record(seq: str, created_ms: str, further: str) -> Column:
    """Digit sum of a line from its two numbers and its further fields, all columns.

    Signs and leading zeros add nothing, so the numbers stand for their text; only
    further fields, where there are any, are read as text.
    """
    return F.expr(f"{_number_sql(seq)} + {_number_sql(created_ms)}"
                  f" + IF(octet_length({further}) = 0, 0L, {_text_sql(further)})")
