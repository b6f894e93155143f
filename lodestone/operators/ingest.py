"""Documents to an index: extract, chunk, reuse, embed what is new, upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions.chunking import build_chunks
from lodestone.functions.extract import extract_text
from lodestone.functions.text import derive_code, embedding_view, estimate_tokens, extension, fingerprint, title_for
from lodestone.operators.transports import EmbedTransport, embed_all
from lodestone.sources.shared import cut
from lodestone.sources.store import upsert


def read_documents(files: DataFrame, citation: str) -> tuple[DataFrame, DataFrame]:
    """(path, content) -> (documents, failures): one bad file is a failure row and stops nothing."""
    read = cut(files.select("path", extract_text(F.col("path"), F.col("content")).alias("x")))  # read twice, parsed once
    good = read.filter(F.col("x.error").isNull()).select(
        "path", derive_code(F.col("path"), F.lit(citation)).alias("code"), F.col("x.text").alias("text"), F.col("x.raw").alias("raw")
    )
    return good, read.filter(F.col("x.error").isNotNull()).select(F.col("path").alias("key"), F.col("x.error").alias("error"))


def describe(docs: DataFrame, manifest: DataFrame, collection: str) -> DataFrame:
    """Documents with title, keywords, kind and link of the manifest, by code."""
    known = manifest.select("code", F.col("title").alias("listed"), "keywords", "doctype", "source_url")
    joined = docs.join(known, "code", "left")
    title = title_for(F.col("code"), extension(F.col("path")), F.col("raw"), F.col("listed"))
    return joined.select(F.lit(collection).alias("collection"), "code", title.alias("title"), "text", "keywords", "doctype", "source_url")


def view_of(chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Chunks with what is embedded for them and its fingerprint."""
    context = F.col("context") if settings.contextual else None
    view = embedding_view(F.col("text"), F.col("title"), F.col("code"), F.col("keywords"), context)
    return chunks.withColumn("view", view).withColumn("fingerprint", fingerprint(F.col("id"), F.col("view")))


def split_reusable(chunks: DataFrame, existing: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Chunks with ``embedding`` where an existing chunk has the same fingerprint, else null (pending)."""
    old = view_of(existing.filter(F.col("embedding").isNotNull()), settings).select("fingerprint", "embedding").dropDuplicates(["fingerprint"])
    return view_of(chunks, settings).join(old, "fingerprint", "left")


def embed_pending(chunks: DataFrame, make: Callable[[], EmbedTransport], settings: Settings = DEFAULT) -> DataFrame:
    """Vectors for the rows that have none; only those go to the model, each once.

    The new vectors are written to the shared folder before they are used, so
    that what reads the result doesn't call the model again.
    """
    schema = "id string, embedding array<float>, tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = make()
        for pdf in batches:
            if len(pdf):
                out = embed_all(transport, pdf["view"].tolist(), "document", settings.embed_batch, attempts=settings.embed_attempts)
                share = [out.tokens // len(pdf)] * (len(pdf) - 1)
                yield pd.DataFrame({"id": pdf["id"], "embedding": out.vectors, "tokens": [*share, out.tokens - sum(share)]})

    pending = chunks.filter(F.col("embedding").isNull())
    fresh = cut(pending.select("id", "view").mapInPandas(run, schema))
    done = pending.drop("embedding").join(fresh, "id").withColumn("reused", F.lit(False))
    kept = chunks.filter(F.col("embedding").isNotNull()).withColumn("tokens", F.lit(0).cast("long")).withColumn("reused", F.lit(True))
    return kept.unionByName(done)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``ord``, their place by code and index, from 0.

    Places come from range partitions and the rows before each, so that no task
    sorts a whole collection; only codes and indexes are sorted.
    """
    keys = rows.select("id", "code", "index").repartitionByRange("code", "index").sortWithinPartitions("code", "index", "id")
    keys = cut(keys.withColumn("_n", F.monotonically_increasing_id()))
    part, within = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = keys.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    placed = keys.withColumn("_part", part).join(F.broadcast(offsets), "_part").select("id", (F.col("_before") + within).alias("ord"))
    return rows.join(placed, "id")


def summary(embedded: DataFrame, documents: int, settings: Settings = DEFAULT) -> DataFrame:
    """One row: documents, chunks, embedded, reused, tokens (estimated where the model says none), cost."""
    estimated = F.sum(F.when(~F.col("reused"), estimate_tokens(F.col("view"))))
    tokens = F.when(F.sum("tokens") > 0, F.sum("tokens")).otherwise(F.coalesce(estimated, F.lit(0)))
    return embedded.agg(
        F.lit(documents).cast("long").alias("documents"),
        F.count("*").alias("chunks"),
        F.count_if(~F.col("reused")).alias("embedded"),
        F.count_if("reused").alias("reused"),
        tokens.cast("long").alias("tokens"),
    ).withColumn("cost_usd", F.col("tokens") / F.lit(1e6) * F.lit(settings.embed_price_per_million))


def ingest(
    files: DataFrame,
    manifest: DataFrame,
    existing: DataFrame,
    collection: str,
    citation: str,
    make: Callable[[], EmbedTransport],
    contexts: DataFrame | None = None,
    reuse: bool = True,
    settings: Settings = DEFAULT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, run summary, failures): the collection's new index rows with ``ord``.

    existing: the chunks that may be reused and stay (see ``store.reusable``),
    with ``ord``.  Contexts attach whether or not vectors are reused.
    """
    docs, failures = read_documents(files, citation)
    chunks = cut(build_chunks(describe(docs, manifest, collection), settings))
    if contexts is not None:
        chunks = chunks.join(contexts, "id", "left")
    else:
        chunks = chunks.withColumn("context", F.lit(None).cast("string"))
    if chunks.isEmpty():
        raise ValueError("no chunk came of these documents: all of them failed")
    old = existing if reuse else existing.limit(0)
    embedded = embed_pending(split_reusable(chunks, old, settings), make, settings)
    ordered = numbered(embedded)
    columns = [c for c in existing.columns if c != "ord"]
    index = upsert(existing, ordered.select(*columns, "ord"), ["collection", "id"])
    return index, summary(embedded, docs.count(), settings), failures
