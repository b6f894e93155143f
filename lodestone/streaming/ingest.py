"""Incremental ingest: new files stream in, each batch is extracted, chunked and upserted.

Chunks are keyed, so a batch that is run again after a failure changes nothing.
One writer per collection is assumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.config import DEFAULT, Settings
from lodestone.functions.chunking import build_chunks
from lodestone.functions.text import is_document
from lodestone.operators.ingest import describe, embed_pending, numbered, read_documents, split_reusable
from lodestone.operators.transports import EmbedTransport
from lodestone.sources.store import CHUNK_SCHEMA, exists, latest


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New documents below a folder as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    return raw.load(folder).filter(is_document(F.col("path"))).select("path", "content")


def start(
    spark: SparkSession,
    folder: str,
    index: str,
    checkpoint: str,
    collection: str,
    citation: str,
    manifest: DataFrame,
    make: Callable[[], EmbedTransport],
    settings: Settings = DEFAULT,
    once: bool = True,
    merge_every: int = 20,
) -> StreamingQuery:
    """Keep the index at ``index`` up to date.

    A batch writes only its own chunks, as a version folder of its own, and a
    batch that is run again writes the same folder again.  Where ``merge_every``
    versions stand behind it, it merges them first; they go when the merged
    folder is whole.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = [f for f in folders(session, index) if f[0] < number]
        if len(before) >= max(2, merge_every):
            done = before[-1][0]
            _merged(session, index, before).write.mode("overwrite").parquet(f"{index}/merged={done}")
            for _, name in before:
                _path(session, f"{index}/{name}", delete=True)
            before = [(done, f"merged={done}")]
        old = _merged(session, index, before)
        docs, failures = read_documents(batch, citation)
        chunks = build_chunks(describe(docs, manifest, collection), settings).withColumn("context", F.lit(None).cast("string"))
        same = old.join(chunks.select("id").distinct(), "id", "left_semi")  # what the batch may replace
        embedded = numbered(embed_pending(split_reusable(chunks, same, settings), make, settings))
        last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m")).first()["m"]
        placed = embedded.withColumnRenamed("ord", "_new").join(same.select("id", F.col("ord").alias("_old")), "id", "left")
        new = placed.withColumn("ord", F.coalesce("_old", F.col("_new") + F.lit(last + 1))).select(*old.columns)
        new.write.mode("overwrite").parquet(f"{index}/v={number}")
        failures.write.mode("overwrite").parquet(f"{index}/failures/batch={number}")

    writer = file_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _path(spark: SparkSession, folder: str, delete: bool = False) -> list[str]:
    """Names of the folders in ``folder``, none if it isn't there; or removes it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    if delete:
        fs.delete(path, True)
        return []
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]


def folders(spark: SparkSession, index: str) -> list[tuple[int, str]]:
    """(number, name) of the folders that make the index: the last merged one and the versions after it, whole ones only."""
    found = [(int(n.partition("=")[2]), n) for n in _path(spark, index) if n.startswith(("v=", "merged=")) and exists(spark, f"{index}/{n}/_SUCCESS")]
    merged = max((f for f in found if f[1].startswith("merged=")), default=None)
    later = sorted(f for f in found if f[1].startswith("v=") and (merged is None or f[0] > merged[0]))
    return [*([merged] if merged else []), *later]


def _merged(spark: SparkSession, index: str, parts: list[tuple[int, str]]) -> DataFrame:
    """The newest row of each chunk."""
    if not parts:
        return spark.createDataFrame([], CHUNK_SCHEMA + ", ord long")
    parts = [spark.read.parquet(f"{index}/{name}").withColumn("_v", F.lit(number)) for number, name in parts]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return (rows if len(parts) == 1 else latest(rows, ["collection", "id"], [F.desc("_v")])).drop("_v")


def current(spark: SparkSession, index: str) -> DataFrame:
    """The index as the versions make it."""
    found = folders(spark, index)
    if not found:
        raise FileNotFoundError(f"no index at {index}")
    return _merged(spark, index, found)
