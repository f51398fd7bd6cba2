import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamlat.functions import lines as L
from streamlat.operators import records
from streamlat.plans.record_latency import record_latency

BAD = ["7", "7 ", "", "7 abc", "7  100", " 7 100", "7 100\t", "7 100\r", "\t7 100", "7\x00 100",
       "7 1.0", "7 1e3", "7 0x10", "7 9223372036854775808", "- 100", "7 +", None]
GOOD = {"7 100": (7, 100), "7 100 x": (7, 100), "+7 -100": (7, -100), "007 0100": (7, 100),
        "-0 5": (0, 5), "9223372036854775807 -9223372036854775808": (2**63 - 1, -(2**63)),
        "7 100 ": (7, 100)}


@pytest.mark.parametrize("text", BAD)
def test_strict_parsing_stops_at_a_bad_line(lines, text):
    with pytest.raises(Exception, match="USER_RAISED|CAST_INVALID_INPUT"):
        lines("1 1", text).transform(records.parse_lines).collect()


def test_good_lines_parse_the_same_both_ways(lines):
    for lenient in (False, True):
        rows = lines(*GOOD).transform(records.parse_lines, lenient=lenient).collect()
        assert {r.line: (r.seq, r.created_ms) for r in rows} == GOOD


def test_lenient_parsing_leaves_out_exactly_the_rejected_lines(lines):
    df = lines(*GOOD, *BAD)
    kept = {r.line for r in df.transform(records.parse_lines, lenient=True).collect()}
    rejected = [r.line for r in df.transform(records.rejected_lines).collect()]
    assert kept == set(GOOD)
    assert sorted(rejected, key=str) == sorted(BAD, key=str)


def test_parsed_columns_cannot_be_null(lines):
    schema = lines("7 100").transform(records.parse_lines).schema
    assert not schema["seq"].nullable and not schema["created_ms"].nullable


def test_only_fields_that_are_read_are_checked(lines):
    # The text result of the record query depends on the second field alone.
    result = record_latency(lines("x 100"), now=F.lit(150).cast("long")).select("result")
    assert result.collect()[0].result == "x 100 150 50"


@pytest.mark.parametrize("text, kept", [
    ("7 100", "7 100"), ("7 100 x 9", "7 100"), ("7  x", "7 "), ("a b ", "a b")])
def test_keep_fields(lines, text, kept):
    assert lines(text).transform(records.cut_fields).collect()[0].line == kept


@pytest.mark.parametrize("text", ["7", "7 ", "", "  ", None])
def test_keep_fields_needs_the_fields(lines, text):
    with pytest.raises(Exception, match="USER_RAISED"):
        lines(text).transform(records.cut_fields).collect()


def test_later_fields(lines):
    df = lines("5 1000 1600 600")
    field = df.select(L.parse_field(F.col("line"), 2, "x").alias("f")).collect()[0].f
    assert field == 1600


def test_record_value_needs_a_value(spark):
    good = spark.createDataFrame([(bytearray(b"7 100"),)], "value binary")
    assert records.message_lines(good).collect()[0].line == "7 100"
    with pytest.raises(Exception, match="USER_RAISED"):
        records.message_lines(spark.createDataFrame([(None,)], "value binary")).collect()


def test_format_result(typed):
    df = typed((7, 100)).select(
        L.format_result(F.col("seq"), F.col("created_ms")).alias("plain"),
        L.format_result(F.col("seq"), F.col("created_ms"), newline=True).alias("ended"))
    assert tuple(df.collect()[0]) == ("7 100", "7 100\n")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-2**63, 2**63 - 1), st.integers(-2**63, 2**63 - 1)),
                min_size=1, max_size=200))
def test_written_lines_parse_back(spark, pairs):
    df = spark.createDataFrame([(f"{a} {b}",) for a, b in pairs], "line string")
    rows = df.transform(records.parse_lines).collect()
    assert [(r.seq, r.created_ms) for r in rows] == pairs
