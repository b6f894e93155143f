"""Command lines: ingest, retrieve and ask over an index folder (for spark-submit).

    python -m lodestone.cli ingest --docs DIR --index DIR --collection NAME [--fresh]
    python -m lodestone.cli retrieve --index DIR --collection NAME [--k N] QUESTION
    python -m lodestone.cli ask --index DIR --collection NAME --llm NAME [--llm-url URL --llm-model MODEL --llm-key-env NAME] QUESTION
"""

from __future__ import annotations

import argparse
import functools
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators import answer, ingest, retrieve
from lodestone.operators.transports import embed_all, embed_transport, llm_transport
from lodestone.sources import store
from lodestone.sources.collections import Collection

_FULL = store.CHUNK_SCHEMA + ", ord long"


def _existing(spark: SparkSession, index: str, collection: str):
    if store.index_exists(spark, index, collection):
        return store.load_index(spark, index, collection)
    return spark.createDataFrame([], _FULL)


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    files = store.list_documents(spark, a.docs, a.collection, legacy=a.collection)
    manifest = store.load_manifest(spark, a.docs, a.collection, a.link_base)
    old = _existing(spark, a.index, a.collection)
    rows, total, failures = ingest.ingest(files, manifest, old, a.collection, a.citation, lambda: embed_transport(a.embed), reuse=not a.fresh)
    transport = embed_transport(a.embed)
    meta = spark.createDataFrame([(a.collection, transport.model, transport.id, "", transport.dims, False, None)], store.META_SCHEMA)
    report = total.first().asDict() | {"failures": [r.asDict() for r in failures.collect()]}
    # Written beside and swapped in: the rows are read from the folder that is replaced.
    store.save_index(rows, meta, f"{a.index}.next", f"{a.index}.meta")
    store.save_index(spark.read.parquet(f"{a.index}.next"), meta, a.index, f"{a.index}.meta")
    return report


def find(spark: SparkSession, a: argparse.Namespace):
    chunks = store.load_index(spark, a.index, a.collection).withColumn("ord", F.col("ord").cast("long"))
    vector = embed_all(embed_transport(a.embed), [a.question], "query").vectors[0]
    asked = spark.createDataFrame([(1, 0, a.question, vector)], "query_id int, variant int, text string, vector array<double>")
    return chunks, retrieve.retrieve(asked, chunks, a.k)


def run_retrieve(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    _, hits = find(spark, a)
    return [r.asDict() for r in hits.select("pos", "code", "title", "score", "lexical", "named").orderBy("pos").collect()]


def run_ask(spark: SparkSession, a: argparse.Namespace) -> dict:
    chunks, hits = find(spark, a)
    questions = spark.createDataFrame([(1, a.question)], "query_id int, question string")
    collection = Collection(a.collection, language=a.language, citation=a.citation)
    options = {"url": a.llm_url, "model": a.llm_model, "key": os.environ.get(a.llm_key_env, "") if a.llm_key_env else None}
    make = functools.partial(llm_transport, a.llm, **{k: v for k, v in options.items() if v is not None})
    make()  # what is missing shows before anything runs
    return answer.ask(questions, hits, chunks, collection, make).first().asDict(recursive=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "retrieve", "ask"):
        c = sub.add_parser(name)
        c.add_argument("--index", required=True)
        c.add_argument("--collection", required=True)
        c.add_argument("--embed", default="hash")
        c.add_argument("--citation", default="instruction", choices=["instruction", "page"])
        c.add_argument("--language", default="he", choices=["he", "en"])
        if name == "ingest":
            c.add_argument("--docs", required=True)
            c.add_argument("--link-base", default="")
            c.add_argument("--fresh", action="store_true")
        else:
            c.add_argument("--k", type=int, default=DEFAULT.rerank_candidates)
            c.add_argument("question")
    sub.choices["ask"].add_argument("--llm", required=True)
    sub.choices["ask"].add_argument("--llm-url")
    sub.choices["ask"].add_argument("--llm-model")
    sub.choices["ask"].add_argument("--llm-key-env", help="name of the variable that holds the key")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    out = {"ingest": run_ingest, "retrieve": run_retrieve, "ask": run_ask}[a.command](spark, a)
    print(json.dumps(out, ensure_ascii=False, indent=1, default=str))


__all__ = ["find", "main", "parser", "run_ask", "run_ingest", "run_retrieve"]

if __name__ == "__main__":
    main()
