"""Quality rules: counts within a document, and lines that many documents of a host share.

A line that more than a share of the distinct documents of its host have is removed, if they
are more than a few; a document that loses most of its words that way is rejected. Lines are
compared without regard to case, digits and spacing. Documents are told apart by their doc_id.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlat.llm.support import WordHashes, broadcast_if_small, hashed, map_texts, runs, written

MOST_SHARE = 0.1       # of a host's documents that may have a line
LEAST_DOCUMENTS = 20   # that may have it on any host
LEAST_LEFT = 0.3       # of its words that a document must keep
LEAST_WORDS = 50
MOST_REPEATED = 50     # percent of the words

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_DIGITS = str.maketrans("0123456789", "0" * 10)

PROFILE = ("doc_id long, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, lines array<long>, line_words array<int>")


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of three that come twice or more."""
    windows = runs(hashes, 3)
    if not len(windows):
        return 0
    _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes), bool)
    again = np.flatnonzero(n[which] > 1)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def normal_line(line: str) -> str:
    return " ".join(line.casefold().translate(_DIGITS).split())


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def measure(text: str, hashes: WordHashes) -> tuple:
    """The numbers of PROFILE after `row`. Lines without a word have no entry."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    normal = [normal_line(line) for line in lines]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(hashed(words, hashes)),
            [signed(xxhash.xxh3_64_intdigest(line.encode())) for line in normal],
            [len(line.encode().split()) for line in lines])


def profile(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of each row, its lines as hashes, and the columns named in `keep`, written."""
    def make():
        from pyspark import TaskContext

        hashes, at = WordHashes(), [TaskContext.get().partitionId() << 40]
        names = PROFILE.replace("long", "").split(",")
        names = [n.split()[0] for n in names][2:]

        def step(batch, texts):
            made = dict(zip(names, zip(*(measure(t, hashes) for t in texts))))
            made["row"] = at[0] + np.arange(len(texts))
            at[0] += len(texts)
            return made | {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *keep)}
        return step

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                         *[F.col(c).cast("string").alias(c) for c in keep if c != "text"])
    return written(map_texts(narrow, PROFILE + "".join(f", {c} string" for c in keep), make), "profile")


def frequent_lines(profiles: DataFrame, share: float, least: int) -> DataFrame:
    """(host, line) of lines in more than `least` documents and more than `share` of those of a host, written.

    A document is a doc_id, however many rows it has; a row without one is a document of its own.
    """
    alone = F.when(F.col("doc_id").isNull(), F.col("row")).alias("alone")
    documents = (profiles.select("host", "doc_id", alone).distinct().groupBy("host")
                 .agg(F.count("*").alias("documents")).where(F.col("documents") > least))
    # Lines that come once in a task's rows of a document are put together before they are sent.
    distinct = profiles.select("host", "doc_id", alone, F.explode(F.array_distinct("lines")).alias("line")).distinct()
    counts = distinct.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hosts = broadcast_if_small(written(documents, "hosts"), 64)
    return written(counts.join(hosts, "host").where(F.col("n") > share * F.col("documents"))
                   .select("host", "line"), "frequent")


def quality(docs: DataFrame, *, host: str = "source", share: float = MOST_SHARE,
            least: int = LEAST_DOCUMENTS, least_left: float = LEAST_LEFT, with_text: bool = False) -> DataFrame:
    """Counts and verdict of each row; with `with_text`, its text without the removed lines.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and n_removed_words. A missing text has no words and fails. Rows without a host are
    those of one more host. Repeated rows come out each time and count as one document. A line is
    removed if more than `least` documents and more than `share` of those of its host have it.
    """
    keep = [host] + ["text"] * with_text
    profiles = profile(docs, *keep).withColumn("host", F.coalesce(F.col(host), F.lit("")))
    frequent = broadcast_if_small(frequent_lines(profiles, share, least), 64)
    lines = profiles.select("row", "host", F.posexplode(F.arrays_zip("lines", "line_words"))
                            .alias("number", "both"))
    removed = (lines.select("row", "host", "number", F.col("both.lines").alias("line"),
                            F.col("both.line_words").alias("n"))
               .join(frequent, ["host", "line"]).groupBy("row")
               .agg(F.sum("n").alias("gone"), F.collect_set("line").alias("removed")))
    both = profiles.join(broadcast_if_small(removed.select("row", "gone"), 32)
                         if not with_text else removed, "row", "left")
    gone = F.coalesce("gone", F.lit(0)).cast("long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words")
                                                 > MOST_REPEATED * F.col("n_words"))
    out = both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= least_left * F.col("n_words"))).alias("kept"),
        gone.alias("n_removed_words"), *(["text", "lines", "removed"] if with_text else []))
    return _stripped(out) if with_text else out


def _stripped(rated: DataFrame) -> DataFrame:
    """`text` without the lines whose hashes are in `removed`; lines without a word stay."""
    def make():
        def step(batch, texts):
            made = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            hashes, gone = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                            for c in ("lines", "removed"))
            made["text"] = [strip_lines(t, h, set(g or ())) for t, h, g in zip(texts, hashes, gone)]
            return made
        return step

    names = [c for c in rated.columns if c not in ("text", "lines", "removed")]
    schema = ", ".join(f"{n} {t}" for n, t in rated.dtypes if n in names) + ", text string"
    return map_texts(rated, schema, make)


def strip_lines(text: str, hashes: list[int], gone: set[int]) -> str:
    if not gone:
        return text
    entries = iter(hashes)
    return "\n".join(line for line in text.split("\n")
                     if not (line.strip(BLANKS) and next(entries) in gone))
