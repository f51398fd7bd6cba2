"""The operators over their whole tables, by name, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.llm import (arrow_files, decontamination, dialogue, exact_copies, hard_negatives, html_text, language,
                           near_duplicates, packing, periodic_runs, personal_data, quality, token_counts)
from streamlat.llm.support import read, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def enter(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function
    return enter


# Ids of items with a window in a document, by comparing the windows as texts.
@query("op1_decontamination", """
WITH items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(words) - width + 2),
        lambda p: array_to_string(words[p:p + width - 1], ' '))) AS win
    FROM (SELECT *, least(10, len(words)) AS width FROM items) WHERE width > 0),
docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents),
places AS (
    SELECT doc_id, width, unnest(range(1, len(words) - width + 2)) AS place,
           unnest(list_transform(range(1, len(words) - width + 2),
                                 lambda p: array_to_string(words[p:p + width - 1], ' '))) AS win
    FROM docs, (SELECT DISTINCT width FROM windows)),
found AS (SELECT doc_id, item_id, width, place FROM places JOIN windows USING (width, win)),
hits AS (SELECT doc_id, count(DISTINCT place + k) AS n_hit FROM found, unnest(range(width)) t(k) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""")
def decontaminate(spark, directory):
    return decontamination.contamination(
        read(spark, directory, "documents"), read(spark, directory, "benchmark")).drop("longest", "longest_at")


@query("op2_main_text")
def main_texts(spark, directory):
    return html_text.extract(read(spark, directory, "pages"))


@query("op3_arrow_sequences")
def arrow_sequences(spark, directory, vocabulary=BYTE_BPE):
    manifest = arrow_files.write_sequences(read(spark, directory, "documents"), vocabulary, end_id=0)
    return arrow_files.checksums(arrow_files.read_documents(spark, manifest))


@query("op4_token_counts")
def count(spark, directory, vocabulary=BYTE_BPE):
    counts = token_counts.count_tokens(read(spark, directory, "documents"), vocabulary)
    return counts.withColumn("over_limit", token_counts.over_limit(F.col("n_tokens")))


def perspectives_sql(limit: int) -> str:
    """The SQL for a given limit of `dialogue.perspectives`."""
    return r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           length(coalesce(role, '')) + length(coalesce(text, '')) + 4096 AS cost,
           CAST(coalesce(floor(turn / 4096), 0) AS BIGINT) AS segment
    FROM conversations),
sized AS (
    SELECT conv_id, segment, turn, sum(cost) AS cost, sum(sum(cost)) OVER (PARTITION BY conv_id) AS total
    FROM turns GROUP BY conv_id, segment, turn),
places AS (
    SELECT conv_id, segment, turn, CASE WHEN cost > $limit THEN (cost + $limit - 1) // $limit ELSE 0 END AS shares,
           coalesce(sum(CASE WHEN cost > $limit THEN ((cost + $limit - 1) // $limit + 1) * $limit ELSE cost END) OVER (
               PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // $limit AS part
    FROM sized WHERE total > $limit),
pieces AS (
    SELECT t.conv_id, coalesce(p.segment, 0) AS segment, true AS here, t.turn, role, text,
           CASE WHEN shares > 0 THEN part + 1 + (CAST('0x' || substr(md5(role || '|' || text), 1, 7) AS BIGINT)
               + row_number() OVER (PARTITION BY t.conv_id, t.turn, role, text) - 1) % shares
               ELSE coalesce(part, 0) END AS part
    FROM turns t LEFT JOIN places p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.turn IS NOT DISTINCT FROM p.turn),
firsts AS (
    SELECT conv_id, turn, text FROM pieces WHERE role = 'system'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, text) = 1),
holding AS (
    SELECT p.conv_id, segment, part, any_value(f.turn) AS turn, any_value(f.text) AS text,
           bool_or(role = 'system' AND p.turn IS NOT DISTINCT FROM f.turn AND p.text = f.text) AS held
    FROM pieces p JOIN firsts f ON p.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY p.conv_id, segment, part),
messages AS (
    SELECT conv_id, segment, part, here, turn, role, text FROM pieces
    UNION ALL SELECT conv_id, segment, part, false, turn, 'system', text FROM holding WHERE NOT held),
speakers AS (SELECT DISTINCT conv_id, segment, part, role AS speaker FROM pieces WHERE role <> 'system'),
marked AS (
    SELECT m.*, speaker, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS said,
           CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                ELSE '<|user:' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g')
                     || '|>' END || chr(10) AS header, chr(10) || '<|end|>' || chr(10) AS closing
    FROM messages m JOIN speakers s ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.segment = s.segment AND m.part = s.part),
placed AS (
    SELECT *, row_number() OVER w AS number,
           sum(length(header) + length(said) + length(closing)) OVER w - length(said) - length(closing) AS begins
    FROM marked WINDOW w AS (PARTITION BY conv_id, segment, part, speaker ORDER BY here, turn NULLS FIRST, role, text
                             ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(segment AS BIGINT) AS segment, CAST(part AS BIGINT) AS part, speaker,
       count(*) FILTER (WHERE here) AS n_turns, string_agg(header || said || closing, '' ORDER BY number) AS rendered,
       coalesce(string_agg(CAST(begins AS BIGINT) || ':' || CAST(begins + length(said) AS BIGINT), ',' ORDER BY number)
                FILTER (WHERE role = speaker), '') AS mask
FROM placed GROUP BY conv_id, segment, part, speaker""".replace("$limit", str(limit))


@query("op5_perspectives", perspectives_sql(dialogue.LIMIT))
def rotate(spark, directory):
    made = dialogue.perspectives(read(spark, directory, "conversations"))
    return made.select("conv_id", "segment", "part", "speaker", "n_turns", "rendered",
                       dialogue.mask_text(F.col("mask")).alias("mask"))


@query("op6_near_duplicates")
def near(spark, directory):
    return near_duplicates.components(read(spark, directory, "documents"))


@query("op7_personal_data")
def personal(spark, directory):
    return personal_data.summary(read(spark, directory, "documents"))


@query("op8_best_fit_packing")
def best_fit(spark, directory, vocabulary=WORD_BPE):
    return packing.pack(read(spark, directory, "documents"), vocabulary, end_id=1, tokens="ids_crc32")


@query("op9_line_frequency")
def line_frequency(spark, directory):
    return quality.quality(read(spark, directory, "documents"))


@query("op10_language")
def languages(spark, directory):
    docs = read(spark, directory, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def with_cycle(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten from a place on repeated with a period, both drawn from its doc_id."""
    n = len(words)
    drawn = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if drawn % 10 or not n:
        return words
    rest = drawn // 10
    start = rest % n
    period = 1 + (n - start) // (3 + rest % 8)
    return words[:start] + [words[start + k % period] for k in range(n - start)]


@query("op11_periodic_runs")
def runs_of_words(spark, directory):
    return periodic_runs.summary(periodic_runs.find(read(spark, directory, "documents"), prepare=with_cycle))


@query("op12_hard_negatives", """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           CAST(list_sum(list_transform(list_zip(a.vector, r.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM scores JOIN positives USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""")
def negatives(spark, directory):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(read(spark, directory, "embeddings").withColumn("label", label))
    return hard_negatives.mine(written(rows, "vectors"), F.col("vec_id") % 50 == 0)


@query("op13_exact_copies", """
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM texts JOIN groups USING (text)""")
def copies(spark, directory):
    found = exact_copies.deduplicate(spark, f"{directory}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
