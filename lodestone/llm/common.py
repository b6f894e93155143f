"""Shared helpers: lineage cuts in the cluster's shared folder, Arrow batches, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.memory import release
from lodestone.sources.shared import cut, drop, store
from lodestone.sources.spread import spread

__all__ = ["byte_texts", "cut", "drop", "id_and_text", "keep_representatives", "map_batches", "same_text", "small", "sparing", "store", "table", "texts", "with_text"]

#: Rows of ids or marks that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Rows of a batch that are worked on together where that takes much more memory than the batch.
ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a text column, row by row; null is empty."""
    index = batch.schema.get_field_index(column)
    values = batch.column(index)
    for value in values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()):
        yield value.as_py() or b""


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Strings of a text column, row by row; null is empty."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def sparing(body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` body that gets its batches in slices of ``ROWS`` rows, none empty, and keeps no memory that it doesn't use.

    Workers live on beside the next stages; without this each keeps the most
    that any batch took.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield batch.slice(start, ROWS)
            release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from body(slices(batches))
        release()

    return run


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over batches; ``make`` turns one batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return df.mapInArrow(run, schema)


def with_text(batch: pa.RecordBatch, new: list[str], lengths: str | None = "n_chars") -> pa.RecordBatch:
    """The batch with its text replaced, and its length column where it has one."""
    names = batch.schema.names
    columns = list(batch.columns)
    at = names.index("text")
    columns[at] = pa.array(new, type=batch.schema.field(at).type)
    if lengths in names:
        n = names.index(lengths)
        columns[n] = pa.array([None if x is None else len(x) for x in new], type=pa.int64()).cast(batch.schema.field(n).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def same_text(text: Column) -> Column:
    """A mark that equal texts share; null is empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table (not a plan: it is counted) to be broadcast if it has few rows; joined by shuffle beyond that."""
    return F.broadcast(df) if df.count() <= most else df


def keep_representatives(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of placed (doc_id, same, root); all columns stay.

    It is the row with the least doc_id (rows without one come last), then the
    least mark.  Rows with the same doc_id but other texts are told apart; of
    rows with the same doc_id and text one stays, whatever their other columns.
    Texts are shuffled only where too many rows go, and those of repeated rows.
    """
    named = lambda doc_id, same: F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), same)
    rows = store(placed.groupBy("root", named(F.col("doc_id"), F.col("same")).alias("_row_mark")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row_mark")).alias("r")
    kept = rows.groupBy("root").agg(first).select(F.col("r._row_mark").alias("_row_mark"))
    goes = store(rows.join(kept, "_row_mark", "left_anti").select("_row_mark"))
    again = store(rows.filter("n > 1").join(kept, "_row_mark", "left_semi").select("_row_mark"))
    drop(rows)
    marked = docs.withColumn("_row_mark", named(F.col("doc_id"), same_text(F.col("text")))).join(small(goes), "_row_mark", "left_anti")
    if again.isEmpty():
        return marked.drop("_row_mark")
    once, repeated = (marked.join(small(again), "_row_mark", how) for how in ("left_anti", "left_semi"))
    return once.unionByName(repeated.dropDuplicates(["_row_mark"])).drop("_row_mark")
