"""What several operators share: tables, written intermediate results, words, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.session import new_dir

# Bytes of text that a task holds as Python objects at a time, as pieces and as whole texts.
SLICE_BYTES = 4 << 20
TEXT_BYTES = 1 << 20

# Bytes that may be broadcast; what is larger takes a shuffle or goes in blocks.
BROADCAST_BYTES = 32 << 20


# Rows that go to a Python worker at a time while a step is written.
WRITTEN_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, which are put back at the end."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of parquet files, by any path that Spark can open."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` from files in the shared folder: its lineage ends there, and no executor holds the only copy.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    with settings(spark, WRITTEN_BATCHES):
        df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system of `path` delete it when the driver's JVM ends."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)


def broadcast_if_small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """A broadcast hint where the counted rows fit in `BROADCAST_BYTES`; a shuffle otherwise."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def release() -> None:
    """Give free memory back at the end of a task: its worker process goes on, beside others that need it.

    To be called when the frame that held the task's data is gone.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only where the C library is that of Linux
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in runs of rows with about `size` bytes of text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def text_slices(batches: Iterator[pa.RecordBatch],
                column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The slices with their texts; a missing text is empty."""
    for batch in slices(batches, column, TEXT_BYTES):
        texts = batch.column(batch.schema.get_field_index(column))
        yield batch, [t or "" for t in texts.to_pylist()]


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Columns of `schema` from slices of rows.

    `make` runs once per task and gives a function of (batch, texts) that returns a
    dictionary of arrays, one item per row it makes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def steps(batches):
        step, arrow = make(), to_arrow_schema(kind)
        for batch, texts in text_slices(batches):
            made = step(batch, texts)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type)
                 for f in arrow], schema=arrow)

    def run(batches):
        yield from steps(batches)
        release()

    return df.mapInArrow(run, kind)


def marked(df: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """`row`, all columns of `df` as they are, beside the columns that `map_texts` would give.

    For steps that make one row of each: a filter on the marks, then `row.*`, keeps rows
    whole without a join.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = df.columns
    kind = _parse_datatype_string(schema)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    def steps(batches):
        step, arrow = make(), to_arrow_schema(kind)
        for batch in batches:
            rows = batch.column(0)
            narrow = pa.RecordBatch.from_arrays(
                [rows.field(names.index(c)) for c in ("doc_id", "text")], names=["doc_id", "text"])
            at = 0
            for part, texts in text_slices(iter([narrow])):
                made = step(part, texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(at, part.num_rows),
                     *(x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type)
                       for f in arrow)], names=["row", *arrow.names])
                at += part.num_rows

    def run(batches):
        yield from steps(batches)
        release()

    from pyspark.sql.types import StructType
    return packed.mapInArrow(run, StructType([*packed.schema.fields, *kind.fields]))


class WordHashes(dict):
    """64-bit hash of a word in bytes; holds a bounded number of words."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with their bits stirred (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` items in a row; none if there are fewer."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k:k + n]
    return mixed(out)
