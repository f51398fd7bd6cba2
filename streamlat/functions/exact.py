"""Sums of BIGINT columns that cannot overflow, and whole-number means.

Creation times are about 1.7e12 each, so a plain BIGINT sum fails after some five
million records of one window and key. A decimal sum is right but slow; here each
value is cut into three parts of 21 bits (the top one signed), the parts are summed
as BIGINT (safe up to 2^42 records per group) and put together once per group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART_BITS = 21
_MASK = (1 << PART_BITS) - 1


def div(a: Column, b: Column) -> Column:
    """Whole-number division, truncating towards zero."""
    return F.call_function("div", a, b)


def parts_sql(value: str) -> tuple[str, str, str]:
    """SQL for the high, middle and low part of a BIGINT column."""
    return (f"shiftright({value}, {2 * PART_BITS})",
            f"shiftright({value}, {PART_BITS}) & {_MASK}L",
            f"{value} & {_MASK}L")


def combine(high: str, middle: str, low: str) -> Column:
    """Three part sums, given as SQL, to one DECIMAL(38,0)."""
    return F.expr(f"""CAST(CAST({high} AS DECIMAL(20,0)) * {1 << 2 * PART_BITS}BD
                         + CAST({middle} AS DECIMAL(20,0)) * {1 << PART_BITS}BD
                         + CAST({low} AS DECIMAL(20,0)) AS DECIMAL(38,0))""")


def exact_sum(name: str) -> Column:
    """Aggregate: sum of a BIGINT column as DECIMAL(38,0)."""
    return combine(*[f"sum({part})" for part in parts_sql(name)])


def integer_mean(total: str, n: str) -> Column:
    """Column `total` by column `n`, cut to a whole number, as BIGINT."""
    return F.expr(f"{total} div {n}")
