"""Text lines `seq created_ms [more fields]`: parse, cut and format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a whole number as text, optional sign, nothing around it.
INTEGER_PATTERN = r"\A[+-]?[0-9]+\z"


def record_value(value: Column) -> Column:
    """A message's binary value as text; a message without a value is an error."""
    return F.coalesce(value.cast("string"), _fail("message has no value", "string"))


def _fail(message: str, as_type: str) -> Column:
    return F.raise_error(F.lit(message)).cast(as_type)


def _guarded(text: Column, number: Column, present: Column) -> Column:
    # A Spark cast accepts control characters around a number. Nearly every field is
    # written the way Spark would write it, so the pattern only runs on the others.
    return (F.when(present & (number.cast("string") == text), number)
             .when(present & text.rlike(INTEGER_PATTERN), number))


def _to_long(text: Column, present: Column, what: str, lenient: bool) -> Column:
    """Text to BIGINT. Where that is impossible: NULL if lenient, else an error.

    The zero at the end is never reached. It tells Catalyst that the result is not
    NULL, so window() and filters add no null check that would parse every line twice.
    """
    if lenient:
        return _guarded(text, text.try_cast("long"), present)
    return F.coalesce(_guarded(text, text.cast("long"), present),
                      _fail(f"{what} is not a whole number", "long"),
                      F.lit(0).cast("long"))


def parse_seq(line: Column, *, lenient: bool = False) -> Column:
    """Field 0 as BIGINT; a NULL line is an error too, unless lenient."""
    return _to_long(F.substring_index(line, " ", 1), F.lit(True), "sequence number", lenient)


def parse_created_ms(line: Column, *, lenient: bool = False) -> Column:
    """Field 1 as BIGINT."""
    return parse_field(line, 1, "creation time", lenient=lenient)


def parse_field(line: Column, index: int, what: str, *, lenient: bool = False) -> Column:
    """A later field (`index` from 0) of a line as BIGINT."""
    head = F.substring_index(line, " ", index + 1)
    present = F.octet_length(head) > F.octet_length(F.substring_index(line, " ", index))
    return _to_long(F.substring_index(head, " ", -1), present, what, lenient)


def keep_fields(line: Column, n: int = 2) -> Column:
    """The first `n` fields of a line. Blanks at the end do not count as fields.

    A line with fewer fields is an error.
    """
    body = F.rtrim(line)
    spaces = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" ")))
    return F.coalesce(F.when(spaces >= n - 1, F.substring_index(body, " ", n)),
                      _fail(f"line has fewer than {n} fields", "string"))


def format_result(*fields: Column, newline: bool = False) -> Column:
    """Join fields with single blanks; `newline` ends the line for a socket."""
    line = F.concat_ws(" ", *[field.cast("string") for field in fields])
    return F.concat(line, F.lit("\n")) if newline else line
