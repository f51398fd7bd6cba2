"""Personal data: patterns propose spans, checksums confirm them, words nearby weigh in.

All of it is column expressions. The places of matches follow from the text between them:
a text is split by the pattern, and the lengths of gaps and matches add up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"
CONTEXT_CHARS = 40     # before a span, in which context words count
CONTEXT_SCORE = 0.35
LEAST_SCORE = 0.6      # of a span beyond the base kinds
RUN = 256              # items of a fold between copies


@dataclass(frozen=True)
class Kind:
    """`clue` is a text without which there is no match; `score` that of a confirmed match."""
    name: str
    pattern: str
    clue: str
    score: float
    context: str
    base: bool = True


# The quantifiers of groups are possessive, which changes no match here and keeps the
# matcher from recursing on long runs. For the same reason matches of mail addresses and
# IP addresses may only begin where a run of their characters does, or after a match.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
         "@", 0.9, r"(?i)\b(?:e-?mail|contact|write)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"(?i)\b(?:ip|address|host|server)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, r"(?i)\b(?:card|visa|mastercard|credit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", 0.8,
         r"(?i)\b(?:iban|account|bank|transfer)\b", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3,
         r"(?i)\b(?:ssn|social security)\b", base=False),
]


def scan(items: Column, kind: str, step, finish) -> Column:
    """Fold with a place and an array of results; `step` gives the next place and what it adds.

    In runs of items, so that the array is copied once a run and not once an item.
    """
    def state(at: Column, out: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), out.alias("out"))

    def one(done: Column, item: Column) -> Column:
        at, made = step(done["at"], item)
        return state(at, F.concat(done["out"], made))

    nothing = F.array().cast(kind)
    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(RUN))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(
        firsts, state(F.lit(0), nothing),
        lambda done, first: F.aggregate(
            F.slice(items, first, F.lit(RUN)), state(done["at"], nothing), one,
            lambda last: state(last["at"], F.concat(done["out"], last["out"]))), finish)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last of the digits is the check digit of those before it."""
    def weighed(place: Column) -> Column:
        value = F.substr(digits, F.length(digits) - place, F.lit(1)).try_cast("int") * (1 + place % 2)
        return value - F.when(value > 9, 9).otherwise(0)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, place: total + weighed(place)) % 10 == 0


def mod_97(match: Column) -> Column:
    """Whether the check digits of an account number are right."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, letter: Column) -> Column:
        value = F.when(F.ascii(letter) >= 65, F.ascii(letter) - 55).otherwise(F.ascii(letter) - 48)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    digits = F.length(_digits(match))
    if kind.name == "ip":
        def small(part: Column) -> Column:
            plain = F.ltrim(part, F.lit("0"))
            return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind.name == "card":
        return F.when(digits.between(16, 19), luhn(_digits(match))).otherwise(False)
    if kind.name == "phone":
        return digits.between(8, 15)
    if kind.name == "iban":
        return mod_97(match)
    return F.lit(True)


def _placed(kind: Kind, text: Column, hits: Column) -> Column:
    """Spans of all matches; their places count code points from 0."""
    gaps = F.split(text, kind.pattern, -1)
    both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)),
                      lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap")))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + pair["gap"]
        end = begin + F.length(pair["hit"])
        return end, F.array(F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), end.alias("end"),
                                     pair["hit"].alias("match")))

    spans = scan(both, SPAN, step, lambda done: done["out"])
    return F.when(F.size(hits) > 0, F.filter(spans, lambda s: confirmed(kind, s["match"]))) \
        .otherwise(F.array().cast(SPAN))


def scored(kind: Kind, text: Column, span: Column) -> Column:
    begin = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    before = F.substr(text, (begin + 1).cast("int"), (span["start"] - begin).cast("int"))
    return kind.score + F.when(F.rlike(before, F.lit(kind.context)), CONTEXT_SCORE).otherwise(0.0)


def find(docs: DataFrame) -> DataFrame:
    """`row`, with all columns of each document; `text`; and for each kind a column of its spans.

    A span has kind, start, end, match and score. The base kinds keep all confirmed spans;
    others need a score. A missing text has no spans. Repeated rows come out each time.
    """
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts = texts.select("row", F.coalesce("row.text", F.lit("")).alias("text"))
    hits = texts.select("*", *[
        F.when(F.contains("text", F.lit(k.clue)), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias(k.name) for k in KINDS])
    spans = hits.select("row", "text", *[_placed(k, F.col("text"), F.col(k.name)).alias(k.name)
                                         for k in KINDS])

    def finished(kind: Kind) -> Column:
        rated = F.transform(kind.name, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["match"].alias("match"), scored(kind, F.col("text"), s).alias("score")))
        return rated if kind.base else F.filter(rated, lambda s: s["score"] >= LEAST_SCORE)

    return spans.select("row", "text", *[finished(k).alias(k.name) for k in KINDS])


def joined(kinds: list[Kind]) -> Column:
    """kind:start:end of all spans, in the order of the kinds."""
    return F.concat_ws(",", *[F.transform(k.name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
                              for k in kinds])


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256, and all spans as text."""
    base = [k for k in KINDS if k.base]
    return find(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(KINDS).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each span in `text` replaced by its kind in angle brackets, and n_chars to match.

    Spans that overlap are replaced together, by the kind of the first. A missing text stays missing.
    """
    found = find(docs)
    spans = F.array_sort(F.concat(*[F.transform(k.name, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in KINDS]))

    def step(at: Column, span: Column) -> tuple[Column, Column]:
        gap = F.substr(F.col("text"), (at + 1).cast("int"), (span["start"] - at).cast("int"))
        tag = F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        return (F.greatest(at, span["end"]),
                F.when(span["start"] < at, F.array().cast("array<string>")).otherwise(F.array(gap, tag)))

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substr(F.col("text"), (done["at"] + 1).cast("int")))

    text = (F.when(F.col("row.text").isNull(), F.lit(None)).when(F.size(F.col("found")) == 0, F.col("text"))
            .otherwise(scan(F.col("found"), "array<string>", step, finish)).cast("string"))
    done = found.select("row", "text", spans.alias("found")).select("row", text.alias("clean"))
    columns = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean"), F.lit(0)).cast("long")}
    return done.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
