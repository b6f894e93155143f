"""Reranking by a model's reply: listing, parsing, and the new order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions.text import ws
from lodestone.operators.query_prep import replies
from lodestone.operators.transports import LlmTransport

SYSTEM = "Rank the numbered passages by how likely they hold the answer. Reply with a JSON array of at most 5 passage numbers, best first, and nothing else."


def candidate() -> Column:
    return ~F.col("lexical") & ~F.col("named")


def listing(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, candidates, listing): numbered passages of each query's candidates, cut to a length."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    text = F.substring(F.regexp_replace("text", ws(r"\s+"), " "), 1, settings.rerank_chars)
    entry = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("code"), F.lit(" — "), F.col("title"), F.lit("\n"), text)
    rows = hits.filter(candidate()).withColumn("n", place).select("query_id", F.struct("n", entry.alias("entry")).alias("e"))
    return rows.groupBy("query_id").agg(
        F.count("*").alias("candidates"),
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "\n\n").alias("listing"),
    )


def parse_order(reply: Column, candidates: Column) -> Column:
    """Distinct numbers within range of the first array of numbers in the reply; empty if there is none."""
    numbers = F.split(F.regexp_extract(reply, r"\[([0-9,\s]*)\]", 1), ",")
    whole = F.transform(numbers, lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(F.coalesce(whole, F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 1) & (i <= candidates)))


def apply_order(hits: DataFrame, orders: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Hits in the new order: named ones, the best few candidates, lexical ones.

    orders: (query_id, order).  A query without a usable order, or with fewer
    than two candidates, keeps its list; ``reranked`` and ``rerank_reason`` say
    which.
    """
    by_query = Window.partitionBy("query_id")
    n = F.row_number().over(Window.partitionBy("query_id", "_kind").orderBy("pos"))
    kind = F.when(F.col("lexical"), 2).when(F.col("named"), 0).otherwise(1)
    rows = hits.withColumn("_kind", kind).withColumn("_n", n).join(orders, "query_id", "left")
    rows = rows.withColumn("_cand", F.sum((F.col("_kind") == 1).cast("int")).over(by_query))
    reason = F.when(F.col("_cand") < 2, "nothing-to-rank").when(F.col("order").isNull(), "failed").when(F.size("order") == 0, "unparseable")
    said = F.array_position("order", F.col("_n"))
    key = F.when(said > 0, said).otherwise(F.size("order") + F.col("_n"))
    rows = rows.withColumn("rerank_reason", reason).withColumn("reranked", reason.isNull())
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_kind").orderBy(F.when(F.col("_kind") == 1, key).otherwise(F.col("_n")), "_n")))
    rows = rows.filter(~F.col("reranked") | (F.col("_kind") != 1) | (F.col("_r") <= settings.top_k))
    moved = F.row_number().over(by_query.orderBy("_kind", "_r"))
    place = F.when(F.col("reranked"), moved).otherwise(F.col("pos"))
    return rows.withColumn("_place", place.cast("int")).select(*[c for c in hits.columns if c != "pos"], F.col("_place").alias("pos"), "reranked", "rerank_reason")


def asked(questions: DataFrame, hits: DataFrame, make: Callable[[], LlmTransport], settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, candidates, reply) of each query with two candidates or more: one call each."""
    listed = listing(hits, settings).filter("candidates >= 2").join(questions.select("query_id", "question"), "query_id")
    user = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nPassages:\n\n"), F.col("listing"))
    told = replies(listed, F.lit(SYSTEM), user, make, stage="rerank", attempts=settings.rerank_attempts)
    return told.select("query_id", "candidates", "reply")


def ordered(hits: DataFrame, told: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Hits in the order that the replies give."""
    order = F.when(F.col("reply.text").isNotNull(), parse_order(F.col("reply.text"), F.col("candidates")))
    return apply_order(hits, told.select("query_id", order.alias("order")), settings)


def rerank(questions: DataFrame, hits: DataFrame, make: Callable[[], LlmTransport], settings: Settings = DEFAULT) -> DataFrame:
    """Hits reranked by a model; (query_id, question) and hits -> hits."""
    return ordered(hits, asked(questions, hits, make, settings), settings)
