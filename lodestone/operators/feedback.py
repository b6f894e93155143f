"""Remembered choices: an append-only table, looked up by the nearest question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.operators.dense import dense_topk
from lodestone.sources.store import exists

SCHEMA = "q string, vector array<double>, codes array<string>, label string, collection string, at timestamp"


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def record(choices: DataFrame, path: str) -> None:
    """Append (q, vector, codes, label, collection) rows with the time of writing."""
    choices.select("q", "vector", "codes", "label", "collection", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def recall(questions: DataFrame, remembered: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, collection, vector) and remembered (ord, collection, vector, codes) -> (query_id, matched, codes, similarity).

    The nearest remembered question of the same collection and vector length;
    matched if it is near enough.
    """
    parts = []
    for row in questions.select("collection").distinct().toLocalIterator():  # the declared collections, a small dimension
        own = F.col("collection") == row["collection"]
        near = dense_topk(remembered.filter(own).withColumn("embedding", F.col("vector").cast("array<float>")), questions.filter(own), 1)
        parts.append(near.select("query_id", "ord", "score"))
    if not parts:
        return questions.select("query_id", F.lit(False).alias("matched"), F.array().cast("array<string>").alias("codes"), F.lit(0.0).alias("similarity"))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    joined = questions.select("query_id").join(near.join(remembered.select("ord", "codes"), "ord"), "query_id", "left")
    matched = F.coalesce(F.col("score") >= settings.feedback_similarity, F.lit(False)) & F.lit(settings.feedback_ordering)
    codes = F.when(matched, F.col("codes")).otherwise(F.array().cast("array<string>"))
    return joined.select("query_id", matched.alias("matched"), codes.alias("codes"), F.coalesce("score", F.lit(0.0)).alias("similarity"))


def export_labels(remembered: DataFrame) -> DataFrame:
    return remembered.select("q", "codes", "label", "at")


def newest_first(remembered: DataFrame) -> DataFrame:
    return remembered.withColumn("n", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("at"), "q")))
