"""A dialogue from the view of each of its speakers, for training a model to speak as any of them.

Every participant in turn is the assistant; the others are users with their names. Only what
the assistant says is trained on. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlat.llm.support import broadcast_if_small, written

SYSTEM = "system"
LIMIT = 32 << 20  # cost up to which messages are rendered together
OVERHEAD = 4096  # cost of a message beside its characters
TURNS = 4096  # turn numbers of a segment of a longer dialogue


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def prepared(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                        (F.length(role) + F.length(text) + OVERHEAD).cast("long").alias("cost"))


def places(rows: DataFrame, limit: int) -> DataFrame:
    """(id, at, segment, part, shares): the piece of each turn number, from the costs of those before it.

    A turn number that costs more than the limit by itself has `shares` pieces after `part`.
    """
    segment = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(0)).cast("long")
    sized = (rows.groupBy(F.col("conv_id").alias("id"), segment.alias("segment"), F.col("turn").alias("at"))
             .agg(F.sum("cost").alias("cost")))
    shares = F.when(F.col("cost") > limit, F.ceil(F.col("cost") / limit)).otherwise(0).cast("long")
    taken = F.when(F.col("shares") > 0, (F.col("shares") + 1) * limit).otherwise(F.col("cost"))
    # A segment has at most TURNS turn numbers and the missing one.
    before = Window.partitionBy("id", "segment").orderBy(F.asc_nulls_first("at")).rowsBetween(
        Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum(taken).over(before), F.lit(0)) / limit).cast("long")
    return sized.withColumn("shares", shares).select("id", "at", "segment", part.alias("part"), "shares")


def cut(rows: DataFrame, limit: int) -> DataFrame:
    """(conv_id, segment, part, here, turn, role, text) of dialogues that go in pieces.

    Pieces without the dialogue's first system message get it, with `here` false. Rows of a crowded turn
    number are dealt out by their digest; equal ones are counted first, and their copies dealt out.
    """
    placed = written(places(rows, limit), "turn_places")
    crowded = placed.where("shares > 0")
    hot = broadcast_if_small(crowded, 64)
    both = same("conv_id", "id") & same("turn", "at")
    plain = (rows.join(hot, both, "left_anti").join(placed.where("shares = 0"), both)
             .select("conv_id", "segment", "part", "turn", "role", "text"))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "role", "text")), 1, 7), 16, 10).cast("long")
    dealt = (rows.join(hot, both, "left_semi").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
             .join(hot, both).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
             .withColumn("part", F.col("part") + 1 + (digest + F.col("copy")) % F.col("shares"))
             .select("conv_id", "segment", "part", "turn", "role", "text"))
    pieces = written(plain.unionByName(dealt).withColumn("here", F.lit(True)), "dialogue_pieces")

    system = F.min(F.when(F.col("role") == SYSTEM, F.struct("turn", "text")))
    own = pieces.groupBy("conv_id", "segment", "part").agg(system.alias("own"))
    first = own.groupBy(F.col("conv_id").alias("id")).agg(F.min("own").alias("first")).where("first IS NOT NULL")
    carried = (own.join(first, same("conv_id", "id")).where(~same("own", "first"))
               .select("conv_id", "segment", "part", "first.turn", F.lit(SYSTEM).alias("role"), "first.text",
                       F.lit(False).alias("here")))
    return pieces.unionByName(carried)


def pieces(turns: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """(conv_id, segment, part, messages): messages in the order of turn, role and text.

    A dialogue that costs at most `limit` (its characters, and 4,096 a message) is one piece. A longer one
    goes in segments of 4,096 turn numbers, and these in parts of at most twice the limit, a longer message
    aside. With None for the limit each dialogue is one piece.
    """
    rows = prepared(turns)
    message = F.struct("here", "turn", "role", "text")
    zero = F.lit(0).cast("long")

    def gathered(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("conv_id", "segment", "part")
                .agg(F.sort_array(F.collect_list(message)).alias("messages")))

    def whole(rows: DataFrame) -> DataFrame:
        return gathered(rows.withColumns({"segment": zero, "part": zero, "here": F.lit(True)}))

    if limit is None:
        return whole(rows)
    total = rows.groupBy(F.col("conv_id").alias("id")).agg(F.sum("cost").alias("cost"))
    longer = written(total.where(F.col("cost") > limit).select("id"), "long_dialogues")
    if longer.isEmpty():
        return whole(rows)
    ids = broadcast_if_small(longer, 16)
    return whole(rows.join(ids, same("conv_id", "id"), "left_anti")).unionByName(
        gathered(cut(rows.join(ids, same("conv_id", "id"), "left_semi"), limit)))


def escaped(text: Column) -> Column:
    r"""Text without `<|`: a backslash goes in between, one more where some are there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """A name without `|>` either, which ends it in a header."""
    return F.regexp_replace(escaped(name), r"\|(\\*)>", r"|\\$1>")


def header(role: Column, name: Column, speaker: Column) -> Column:
    return (F.when(role == speaker, F.lit("<|assistant|>\n")).when(role == SYSTEM, F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), name, F.lit("|>\n"))))


END = "\n<|end|>\n"


def perspectives(turns: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """One row for each piece of a dialogue and participant who speaks in it.

    conv_id, segment, part, speaker, n_turns (messages of the piece); messages with role, name, content
    and train; rendered, the piece as text; and mask, the parts of it to train on, from start to before end
    in characters. A dialogue of up to 32 million characters, of which each message counts 4,096 more than it
    has, is one piece, 0 and 0; a longer one goes in several, each with the dialogue's first system message,
    and a participant who says nothing in a piece would have nothing to train on there. With None for the
    limit the rows have this form at any length: a dialogue is one piece, and a task has to hold it. A system
    message is nobody's turn, so a dialogue of nothing else has no row. A missing role is a participant without
    a name, a missing text is empty, a missing turn comes first.
    Turns of one number are in the order of role and text, equal rows are as many messages. Dialogues
    without id are one dialogue. Markers within names and texts are escaped in `rendered`.
    """
    parts = pieces(turns.select("conv_id", "turn", "role", "text"), limit)
    own = F.transform(F.filter("messages", lambda m: m["here"] & (m["role"] != SYSTEM)), lambda m: m["role"])
    ready = F.transform("messages", lambda m: m.withField("name", escaped_name(m["role"]))
                        .withField("said", escaped(m["text"])))
    both = parts.select(
        "conv_id", "segment", "part", F.size(F.filter("messages", lambda m: m["here"])).cast("long").alias("n_turns"),
        ready.alias("messages"), F.explode(F.array_distinct(own)).alias("speaker"))
    speaker = F.col("speaker")

    def message(m: Column) -> Column:
        role = m["role"]
        mine = role == speaker
        return F.struct(
            F.when(mine, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
            .alias("role"), role.alias("name"), m["text"].alias("content"), mine.alias("train"),
            header(role, m["name"], speaker).alias("header"), m["said"].alias("said"))

    made = both.withColumn("turns", F.transform("messages", message))
    rendered = F.array_join(F.transform("turns", lambda m: F.concat(m["header"], m["said"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, m: Column) -> Column:
        begin = done["at"] + F.length(m["header"])
        end = begin + F.length(m["said"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"),
                        F.when(m["train"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return made.select(
        "conv_id", "segment", "part", "speaker", "n_turns",
        F.transform("turns", lambda m: m.dropFields("header", "said")).alias("messages"),
        rendered.alias("rendered"), F.aggregate("turns", start, step, lambda done: done["spans"]).alias("mask"))


def mask_text(mask: Column) -> Column:
    """start:end of each part, joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
