"""Token ids as Arrow files of equal-length sequences, read back without copying.

The documents in the order of their ids make one stream of tokens, each closed by an end
id. A range of documents is one file of record batches with two fixed-size lists: `ids`,
and `mask`, which is false where the last sequence is filled up. A sequence of any number
is a slice of the mapped file. Beside each file an index says where its documents start.

Files have names of their own attempt; only those that the manifest names belong to the
result, so a task that ran twice or was lost half-way leaves nothing that is read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamlat.llm.support import remove_at_exit, slices, written
from streamlat.llm.vocabulary import encoding
from streamlat.session import new_dir

SEQUENCE = 2048   # tokens of a sequence
BATCH = 64        # sequences of a record batch

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, ids_path string, index_path string, n_docs long, n_tokens long"


def schema(dtype: str, length: int) -> pa.Schema:
    ids = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))],
                     {"sequence": str(length)})


class SequenceWriter:
    """Writes a stream of ids as record batches of equal-length sequences."""

    def __init__(self, sink, dtype: str, length: int):
        self.dtype, self.length = dtype, length
        self.schema = schema(dtype, length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.left = np.zeros(0, dtype)

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.left, ids])
        size = self.length * BATCH
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._write(ids[at:at + size], size)
        self.left = ids[whole:]

    def _write(self, ids: np.ndarray, n_real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n_real)
        fields = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                  pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.file.write_batch(pa.RecordBatch.from_arrays(fields, schema=self.schema))

    def close(self) -> None:
        if n := len(self.left):
            self._write(np.concatenate([self.left, np.zeros(-n % self.length, self.dtype)]), n)
        self.file.close()


def qualified(spark: SparkSession, path: str) -> str:
    """The URI by which Spark knows `path`, so that executors do not take another file system for it.

    One that pyarrow cannot open is refused here.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    _opened(uri)
    return uri


def _opened(path: str):
    """The file system of a URI, and the path in it."""
    # Hadoop writes file:/a, and pyarrow wants file:///a.
    return fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and path[6:7] != "/" else path)


def write_sequences(docs: DataFrame, vocabulary: str, *, end_id: int = 0,
                    length: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """Write the tokens of all documents; returns the manifest, a row for each file.

    Parts follow each other in ascending doc_id; documents of the same id lie next to each
    other, those without an id come first. A missing text is an empty one: just the end id.
    Without documents there are no files. `path` must be a folder that all executors share.
    """
    spark = docs.sparkSession
    if path is None:
        path = new_dir(spark, "sequences")
        remove_at_exit(spark, path)
    path = qualified(spark, path)

    def run(batches):
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), None
        with encoding(vocabulary) as encode:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
                    store, at = _opened(name)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    sinks = [store.open_output_stream(f"{at}{end}") for end in (".arrow", ".index.arrow")]
                    out = SequenceWriter(sinks[0], encode.dtype, length)
                    index, n_docs, n_tokens = pa.ipc.new_file(sinks[1], INDEX), 0, 0
                for rows in slices(iter([batch])):
                    ids, counts = encode(rows.column(1))
                    with_end = np.insert(ids, np.cumsum(counts), np.array(end_id, ids.dtype))
                    counts = counts + 1
                    starts = n_tokens + np.cumsum(counts) - counts
                    out.add(with_end)
                    index.write_batch(pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(starts), pa.array(counts)], schema=INDEX))
                    n_docs, n_tokens = n_docs + len(counts), n_tokens + int(counts.sum())
        if out is not None:
            out.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "ids_path": [f"{name}.arrow"],
                 "index_path": [f"{name}.index.arrow"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def sequence(path: str, number: int, batch: int = BATCH) -> tuple[np.ndarray, pa.Array]:
    """Ids (a view of the mapped file) and mask of one sequence of a local file."""
    file = pa.ipc.open_file(pa.memory_map(path.removeprefix("file:").replace("///", "/", 1)))
    rows = file.get_batch(number // batch)
    row = number % batch
    n = rows.schema.field("ids").type.list_size
    return (rows.column(0).flatten().to_numpy()[row * n:(row + 1) * n], rows.column(1)[row].values)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files.

    `ids` are little-endian unsigned 32-bit integers; `start` counts from the first document.
    """
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file: the running sum is over the manifest alone.
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = based.repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _documents(row: dict):
    store, at = _opened(row["ids_path"])
    index_store, index_at = _opened(row["index_path"])
    with store.open_input_file(at) as source, index_store.open_input_file(index_at) as place:
        file, index = pa.ipc.open_file(source), pa.ipc.open_file(place)
        stream = (file.get_batch(i) for i in range(file.num_record_batches))
        left = np.zeros(0, "<u4")
        for i in range(index.num_record_batches):
            rows = index.get_batch(i)
            counts = rows.column(2).to_numpy()
            need, have = int(counts.sum()), [left]
            total = len(left)
            while total < need:
                batch = next(stream)
                # What the mask leaves out is at the end of the file.
                real = pc.sum(batch.column(1).flatten()).as_py()
                ids = batch.column(0).flatten().to_numpy()[:real]
                have.append(ids.astype("<u4"))
                total += len(ids)
            ids = np.concatenate(have)
            left, ids = ids[need:], ids[:need]
            offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
            buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.tobytes())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(rows.column(1).to_numpy() + row["base"]), rows.column(2),
                 pa.BinaryArray.from_buffers(pa.binary(), len(counts), buffers)],
                names=["doc_id", "start", "n_tokens", "ids"])


def checksums(tokens: DataFrame) -> DataFrame:
    """`ids_crc32` in place of `ids`."""
    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
