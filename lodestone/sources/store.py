"""Chunk store in Parquet: discovery, manifests, index tables, keyed upserts, legacy readers."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_list, is_document, normalise_keywords

CHUNK_SCHEMA = (
    "id string, collection string, code string, title string, index int, text string, keywords array<string>, "
    "doctype string, source_url string, context string, embedding array<float>"
)
META_SCHEMA = "collection string, embed_model string, embed_transport string, region string, dims int, contextual boolean, indexed_at timestamp"
BINARY_CHUNKS = 2000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Files ------------------------------------------------------------------------


def list_documents(spark: SparkSession, root: str, collection: str, legacy: str | None = None) -> DataFrame:
    """(path, content, length) of a collection's documents; the legacy collection may lie in the root itself."""
    folder = f"{root}/{collection}"
    if not exists(spark, folder):
        if collection != legacy:
            return spark.createDataFrame([], "path string, content binary, length long")
        folder = root
    files = spark.read.format("binaryFile").load(folder)
    return files.filter(is_document(F.col("path"))).select("path", "content", "length")


def read_companion(spark: SparkSession, root: str, collection: str, name: str) -> DataFrame | None:
    """A JSON file next to the documents: the collection's own, else the shared one, else None."""
    for path in (f"{root}/{collection}/{name}", f"{root}/{name}"):
        if exists(spark, path):
            return spark.read.option("multiLine", True).json(path)
    return None


def _entries(raw: DataFrame) -> list[DataFrame]:
    """Rows (place, fields) of ``downloaded``, or of ``documents`` where that is null or missing."""
    there = [n for n in ("downloaded", "documents") if dict(raw.dtypes).get(n, "").startswith("array<struct")]
    parts, taken = [], F.lit(False)
    for name in there:
        parts.append(raw.filter(~taken & F.col(name).isNotNull()).select(F.posexplode(name).alias("place", "d")).select("place", "d.*"))
        taken = taken | F.col(name).isNotNull()
    return parts


def manifest_rows(raw: DataFrame, link_base: str, precedence: int = 0) -> DataFrame | None:
    """(code, title, keywords, doctype, source_url, version, precedence, place) of a manifest; None if it can't be read as one."""
    out = None
    for rows in _entries(raw):
        if "code" not in rows.columns:
            continue
        has = lambda c, rows=rows: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        words = has("keywords")
        listed = clean_list(words) if dict(rows.dtypes).get("keywords", "").startswith("array") else normalise_keywords(words.cast("string"))
        code = F.col("code").cast("string")
        file = F.when(has("file") != "", F.regexp_replace(has("file"), r"(?i)\.(?:docx|pdf)$", ""))
        part = rows.filter(code.isNotNull() & (code != "")).select(
            code.alias("code"),
            F.coalesce(has("title"), code).alias("title"),
            listed.alias("keywords"),
            has("doctype").alias("doctype"),
            F.coalesce(has("url"), F.concat(F.lit(link_base), F.coalesce(file, F.concat(F.lit("H."), code)))).alias("source_url"),
            has("version").cast("string").alias("version"),
            F.lit(precedence).alias("precedence"),
            "place",
        )
        out = part if out is None else out.unionByName(part)
    return out


def load_manifest(spark: SparkSession, root: str, collection: str, link_base: str = "") -> DataFrame:
    """One row per code; what ``manifest.json`` says overrides ``manifest-all.json``, later rows override earlier ones.

    A file that is no manifest is warned of and left out.
    """
    parts = []
    for level, name in enumerate(("manifest-all.json", "manifest.json")):
        raw = read_companion(spark, root, collection, name)
        if raw is None:
            continue
        rows = manifest_rows(raw, link_base, level)
        if rows is None:
            warnings.warn(f"{name} of {collection} can't be read as a manifest; going on without it", stacklevel=2)
        else:
            parts.append(rows)
    if not parts:
        return spark.createDataFrame([], "code string, title string, keywords array<string>, doctype string, source_url string, version string")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return latest(rows, ["code"], [F.desc("precedence"), F.desc("place")]).drop("precedence", "place")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


# Index ------------------------------------------------------------------------


def load_index(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Chunks of one collection (or all); a missing one is an error, not an empty answer."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no index at {path}: ingest documents first")
    chunks = spark.read.parquet(path)
    if collection is None:
        return chunks
    own = chunks.filter(F.col("collection") == collection)
    if own.isEmpty():
        raise FileNotFoundError(f"collection {collection} has no index: ingest its documents first")
    return own


def index_exists(spark: SparkSession, path: str, collection: str) -> bool:
    return exists(spark, path) and not spark.read.parquet(path).filter(F.col("collection") == collection).isEmpty()


def fully_embedded(chunks: DataFrame, dims: int) -> DataFrame:
    """(collection, fully_embedded)."""
    good = F.coalesce(F.size("embedding") == dims, F.lit(False))
    return chunks.groupBy("collection").agg(F.bool_and(good).alias("fully_embedded"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Existing rows in their order, replaced in place where a new one has their key; other new rows after them.

    Nothing is deleted.  ``order`` is the row's place in each side.
    """
    last = existing.agg(F.coalesce(F.max(order), F.lit(-1)).alias("m")).first()["m"]
    old = existing.select(*keys, F.col(order).alias("_old"), F.struct("*").alias("_a"))
    fresh = latest(new, keys, [F.desc(order)]).select(*keys, F.col(order).alias("_new"), F.struct("*").alias("_b"))
    joined = old.join(fresh, keys, "full_outer")
    others = [c for c in existing.columns if c not in keys and c != order]
    value = lambda c: F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}")).alias(c)
    place = F.coalesce(F.col("_old"), F.col("_new") + F.lit(last + 1)).alias(order)
    return joined.select(*keys, *[value(c) for c in others], place)


def save_index(chunks: DataFrame, metas: DataFrame, path: str, meta_path: str) -> None:
    """Replace the collections that ``chunks`` holds, vectors first, and stamp their envelope."""
    spark = chunks.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        chunks.write.mode("overwrite").partitionBy("collection").parquet(path)
        stamped = metas.withColumn("indexed_at", F.current_timestamp())
        stamped.write.mode("overwrite").partitionBy("collection").parquet(meta_path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def reusable(existing: DataFrame, meta: DataFrame, transport: str, contextual: bool) -> DataFrame:
    """Existing chunks whose vectors may be kept: same transport, same contextual setting."""
    good = meta.filter((F.col("embed_transport") == transport) & (F.coalesce("contextual", F.lit(False)) == contextual))
    return existing.join(good.select("collection"), "collection", "left_semi")


def load_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(id, context) of a JSON object of chunk id to sentence; none where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, context string")
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "context"))


def document_texts(chunks: DataFrame) -> DataFrame:
    """(collection, code, body): each document's chunks in order, each after a line feed."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "text")))
    body = F.array_join(F.transform(ordered, lambda c: F.concat(F.lit("\n"), F.coalesce(c["text"], F.lit("")))), "")
    return chunks.groupBy("collection", "code").agg(body.alias("body"))


# Legacy vector files -----------------------------------------------------------


def choose_format(chunk_count: int, embedded: bool, forced: str | None = None) -> str:
    """json or binary, as older readers expect; only fully embedded indexes can be binary."""
    if forced == "json" or not embedded:
        return "json"
    return "binary" if forced == "binary" or chunk_count >= BINARY_CHUNKS else "json"


def pack_vectors(vectors: list[list[float]], dims: int) -> bytes:
    """Little-endian float32 rows without a header."""
    for i, v in enumerate(vectors):
        if len(v) != dims:
            raise ValueError(f"vector {i} has {len(v)} numbers where {dims} are expected")
    return np.asarray(vectors, dtype="<f4").tobytes()


def read_vectors(spark: SparkSession, path: str, dims: int, count: int) -> DataFrame:
    """(ord, embedding) of a headerless float32 matrix; its size must fit."""
    files = spark.read.format("binaryFile").load(path)
    size = files.select("length").first()["length"]
    if size != count * dims * 4:
        raise ValueError(f"{path} has {size} bytes where {count} x {dims} vectors take {count * dims * 4}")

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                m = np.frombuffer(data, dtype="<f4").reshape(-1, dims)
                for at in range(0, len(m), 1024):
                    part = m[at : at + 1024]
                    yield pd.DataFrame({"ord": range(at, at + len(part)), "embedding": list(part)})

    return files.select("content").mapInPandas(run, "ord long, embedding array<float>")


# Evaluation files ---------------------------------------------------------------


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no gold set at {path}")
    return spark.read.option("multiLine", True).json(path)


load_controls = load_gold
