"""Topics of a hit list, and whether to answer, ask back or refuse."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions.text import trim_all, ws

NONE_OF_THESE = "אף אחד מאלה"


def _title(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(c, "[\"'״׳()]", ""), ws(r"\s+"), " "))


def same_topic(a: Column, b: Column) -> Column:
    """Titles that are equal, hold one another, or share three words and all but one."""
    x, y = _title(a), _title(b)
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 3))
    shared = F.size(F.array_intersect(words(x), words(y)))
    return F.contains(x, y) | F.contains(y, x) | ((shared >= 3) & (shared >= F.least(F.size(words(x)), F.size(words(y))) - 1))


def _alike(a: str, b: str) -> bool:
    x, y = (re.sub(r"\s+", " ", re.sub("[\"'״׳()]", "", t)).strip() for t in (a, b))
    if x in y or y in x:
        return True
    wx, wy = ({w for w in t.split(" ") if len(w) >= 3} for t in (x, y))
    return len(wx & wy) >= max(3, min(len(wx), len(wy)) - 1)


def topics(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, topic, label, codes, score): documents by their best chunk, like titles together, a few topics.

    The merge is greedy in score order; a group is one query's documents.
    """
    best = F.row_number().over(Window.partitionBy("query_id", "code").orderBy(F.desc("score"), "pos"))
    seen = F.min("pos").over(Window.partitionBy("query_id", "code"))
    docs = hits.filter(~F.col("lexical")).withColumn("_n", best).withColumn("seen", seen).filter("_n = 1")
    docs = docs.select("query_id", "code", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("code")).alias("title"), "score", "seen")
    id_type = hits.schema["query_id"].dataType.simpleString()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        for r in pdf.sort_values(["score", "seen"], ascending=[False, True]).itertuples():
            known = next((t for t in found if _alike(t["label"], r.title)), None)
            if known is not None:
                known["codes"].append(r.code)
            elif len(found) < settings.clarify_max_topics:
                found.append({"query_id": r.query_id, "topic": len(found) + 1, "label": r.title, "codes": [r.code], "score": r.score})
        return pd.DataFrame(found, columns=["query_id", "topic", "label", "codes", "score"])

    return docs.groupBy("query_id").applyInPandas(merge, f"query_id {id_type}, topic int, label string, codes array<string>, score double")


def decide(hits: DataFrame, found: DataFrame, threshold: Column, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, decision): refuse below the floor, answer one topic or a confident best, else clarify.

    threshold is a column of ``hits``: the confidence score of its collection.
    """
    first = hits.filter(~F.col("lexical")).groupBy("query_id").agg(F.min_by("score", "pos").alias("best"), F.max(threshold).alias("least"))
    asked = hits.select("query_id").distinct().join(first, "query_id", "left")
    counted = found.groupBy("query_id").agg(F.count("*").alias("topics"))
    best = F.coalesce("best", F.lit(0.0))
    sure = (best >= F.col("least")) & F.lit(not settings.clarify_always)
    decision = (
        F.when(best < settings.clarify_min_score, "refuse").when(F.coalesce("topics", F.lit(0)) <= 1, "answer").when(sure, "answer").otherwise("clarify")
    )
    return asked.join(counted, "query_id", "left").select("query_id", decision.alias("decision"))


def clarification(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, clarification): the question, its topics in order, and the label for none of them."""
    listed = F.array_sort(F.collect_list(F.struct("topic", "label", "codes", "score")))
    rows = found.groupBy("query_id").agg(listed.alias("topics"))
    record = F.struct("question", "topics", F.lit(NONE_OF_THESE).alias("none_label"))
    return questions.join(rows, "query_id").select("query_id", record.alias("clarification"))
