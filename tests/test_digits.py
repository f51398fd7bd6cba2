from hypothesis import given, settings
from hypothesis import strategies as st

from streamlat.functions.digits import digit_sum, digit_sum_long
from streamlat.operators import records


def by_hand(text):
    return sum(int(c) for c in text if c in "0123456789")


TEXTS = st.text(st.characters(codec="utf-8"), max_size=60) | st.text("0123456789 +-.x", max_size=60)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=200))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    rows = df.select(digit_sum("line").alias("d")).collect()
    assert [r.d for r in rows] == [by_hand(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-2**63, 2**63 - 1), min_size=1, max_size=200))
def test_any_number(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    rows = df.select(digit_sum_long("n").alias("d")).collect()
    assert [r.d for r in rows] == [by_hand(str(n)) for n in numbers]


def test_a_record_counts_its_whole_line(lines):
    texts = ["12 34", "7 100 x", "+007 -0100", "1 2 3 4 5", "1 2  9", "1 2 ٣ 6"]
    rows = (lines(*texts).transform(records.parse_lines)
            .transform(records.with_digit_sum).collect())
    assert [r.digit_sum for r in rows] == [by_hand(t) for t in texts]


def test_appending_and_cutting(lines):
    summed = lines("12 34").transform(records.append_digit_sum)
    assert summed.collect()[0].line == "12 34 10"
    assert summed.transform(records.cut_fields).collect()[0].line == "12 34"


def test_a_long_text(spark):
    df = spark.createDataFrame([("9a" * 500_000,)], "line string")
    assert df.select(digit_sum("line").alias("d")).collect()[0].d == 4_500_000
