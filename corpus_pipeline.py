"""The stages of a corpus pipeline over `documents`, each on what the one before it kept.

All but the last return documents with their columns; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers

from streamlat.llm import decontamination, language, near_duplicates, packing, personal_data
from streamlat.llm.support import read, written


def language_id(spark, docs, sf_dir):
    """Documents in a language that the labelled documents teach."""
    return language.identified(docs, language.train(docs))


def near_duplicate(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return near_duplicates.one_of_each(docs)


def benchmark(spark, docs, sf_dir):
    """Documents without passages of the benchmark."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pii(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind."""
    return personal_data.redacted(docs)


def pack(spark, docs, sf_dir):
    """Token sequences: the pieces of the documents, and where each lies in which sequence."""
    path = public_tokenizers.path("word_bpe_49k.json")
    # Executors have the memory of four earlier stages in use; rows are the same whatever is remembered.
    return packing.pack(docs, path, end_id=1, tokens="ids_crc32", remembered=100_000, slice_bytes=1 << 20)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicate), ("decontamination", benchmark),
          ("personal_data", pii), ("packing", pack)]

# Language, near-duplicates and token ids are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn over `documents`, each written before the next one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
