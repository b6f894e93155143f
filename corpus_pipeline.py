"""Training-corpus pipeline: quality, near duplicates, decontamination, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, pii, quality_classifier, simhash
from lodestone.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject.

    It is fitted on labelled rows of ``docs``.  Null and empty texts are scored
    like any other; rows are judged one by one, repeated ones alike.  No rows
    in, no rows out.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Null and empty texts are one group.  Rows are told apart by id and text:
    rows that share an id but not the text stand for themselves, repeated rows
    and rows without an id go like any other copy.  No rows in, no rows out.
    """
    return simhash.keep_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item.

    Null and empty texts stay; rows are judged one by one, repeated ones alike.
    An empty benchmark keeps all; no rows in, no rows out.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data replaced; null and empty texts stay as they are.  No rows in, no rows out."""
    return pii.redact_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its cleaned text, token ids, their number and hashes; null and empty texts have no ids."""
    import public_tokenizers

    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: No stage's model, hashing or vocabulary can be expressed in DuckDB; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
