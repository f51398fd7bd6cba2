"""Exact copies by a stream over the files of a table, with a state that never forgets a text.

The state lies in RocksDB on the disks of the executors, is kept in the checkpoint, and has an entry for each
digest: where the first text with it lies (file and row), the largest doc_id, and how many rows there were. Rows
of one digest are put together in each task before they are sent, so a text that is everywhere costs no more
than any other. A later run with the same folder reads only the files that are new.

An entry that was hit is checked on the full bytes: the texts of its rows, with the one its place names among
them, must be one text. Texts that are different in spite of one digest are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlat.llm.support import broadcast_if_small, remove_at_exit, settings, written
from streamlat.session import new_dir

FILES = 1000  # of a batch

STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Else each partition of the state takes some MB of disk before it holds anything.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column = "text") -> Column:
    """The text with A-Z in lower case and all else as it is; a missing one is empty."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # Where each character has one byte, lower() changes nothing but A-Z and is much faster.
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, digest: Callable[[Column], Column], *, with_text: bool = False) -> DataFrame:
    """doc_id, digest, file and row of each row, and its normalised text if asked for."""
    place = docs.metadataColumn("_metadata")
    text = normalised(docs["text"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest(text).alias("digest"),
                       place["file_path"].alias("file"), place["row_index"].alias("row"),
                       *[text.alias("text")] * with_text)


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """The entry of each group: its first place, its largest doc_id, its size."""
    # The time of a batch is kept in the checkpoint, so a batch that runs again has it again.
    return rows.withColumn("seen", F.current_timestamp()).groupBy(*keys).agg(
        F.min(F.struct("seen", "file", "row")).alias("holder"), F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"))


def remember(spark: SparkSession, path: str, folder: str, *, digest: Callable[[Column], Column] = sha256,
             files: int = FILES) -> DataFrame:
    """Take the new files of the table at `path` into the state in `folder`; the whole state afterwards.

    A batch takes `files` files. A batch that is run again after a loss changes the state once.
    """
    # A pattern that stands for this path alone: the source takes a single file by pattern only.
    pattern = f"{path[:-1]}[{path[-1]}]"
    docs = (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
            .parquet(pattern))
    entries = _grouped(_rows(docs, digest), "digest")
    with settings(spark, STORE):
        query = (entries.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", folder).trigger(availableNow=True).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(folder)
        holder, keep_id, size = (F.col("value")[f.name] for f in state.schema["value"].dataType)
        known = state.select(F.col("key.digest").alias("digest"), holder["file"].alias("file"),
                             holder["row"].alias("row"), keep_id.alias("keep_id"), size.alias("group_size"))
        return written(known.where("group_size > 1 OR keep_id IS NULL"), "hits")


def collisions(hits: DataFrame, docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests whose rows are not all one text, or without the text at the place that the state names."""
    wanted = broadcast_if_small(hits.where("group_size > 1").select(
        F.col("digest").alias("hit"), F.col("file").alias("held"), F.col("row").alias("held_row")), 160)
    rows = _rows(docs, digest, with_text=True)
    same = rows.join(wanted, rows["digest"] == wanted["hit"]).groupBy("digest").agg(
        F.min("text").alias("least"), F.max("text").alias("most"),
        F.count_if((F.col("file") == F.col("held")) & (F.col("row") == F.col("held_row"))).alias("there"))
    return written(same.where("least <> most OR there <> 1").select("digest"), "collisions")


def deduplicate(spark: SparkSession, path: str, folder: str | None = None, *,
                digest: Callable[[Column], Column] = sha256, files: int = FILES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of each row of the table of parquet files at `path`.

    Texts are equal if they are identical after lower-casing A-Z only. Of equal texts the largest doc_id
    stays: `keep_id` names it, `group_size` counts the rows, and `kept` is true for the rows with that id. A
    missing text is an empty one, and empty texts are equal. Repeated rows come out each time and count each
    time. A row without doc_id stays only if no row with its text has one and it is the first of them. Other
    columns are not read. An empty table gives no rows. `folder` holds the state of earlier runs over the same
    table; without one the state is new and goes with the session. The table must not change during a call.

    `digest` makes a binary of a text; one that takes different texts for one costs time, not rows.
    """
    if folder is None:
        folder = new_dir(spark, "copies")
        remove_at_exit(spark, folder)
    hits = remember(spark, path, folder, digest=digest, files=files)
    docs = spark.read.parquet(path)
    mixed = collisions(hits, docs, digest)
    clear = hits
    several = not mixed.isEmpty()
    if several:
        clear = hits.join(mixed, "digest", "left_anti")
    named = broadcast_if_small(clear.toDF("known", "held", "held_row", "keep_id", "group_size"), 176)
    rows = _rows(docs, digest, with_text=several)
    if several:
        apart = rows.join(broadcast_if_small(mixed, 48), "digest", "left_semi")
        rows = rows.join(broadcast_if_small(mixed, 48), "digest", "left_anti").drop("text")
        exact = _grouped(apart, "digest", "text").select(
            "digest", "text", F.col("holder.file").alias("held"), F.col("holder.row").alias("held_row"),
            "keep_id", "group_size")
        apart = _judged(apart.join(exact, ["digest", "text"]))
    whole = _judged(rows.join(named, rows["digest"] == named["known"], "left"))
    return whole.union(apart) if several else whole


def _judged(rows: DataFrame) -> DataFrame:
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.coalesce("keep_id", "doc_id")
    first = (F.col("file") == F.col("held")) & (F.col("row") == F.col("held_row"))
    return rows.select("doc_id", keep.alias("keep_id"), size.alias("group_size"),
                       F.coalesce(F.col("doc_id") == keep, first & keep.isNull(), F.lit(False)).alias("kept"), "digest")
