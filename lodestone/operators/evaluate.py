"""Evaluation: verdicts, rank metrics, latency, validity, failure stages, retry meter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions.text import contains_fact, is_refusal, mentions_refusal, refusal_remainder, trim_all
from lodestone.functions.unicode import nfkc
from lodestone.operators.query_prep import replies
from lodestone.operators.transports import LlmTransport

JUDGE = "You check answers. Given a fact and an answer, reply with one word: כן if the answer states the fact, in whatever words, else לא."
JUDGE_ASKED = "You check answers. Given a question, its right value and an answer, reply with one word: כן if the answer gives that value, else לא."
STAGES = ["ok", "search-ceiling", "ranker-dropped", "refused-though-ranked", "answered-cited-other", "right-doc-wrong-value"]


# Metrics ------------------------------------------------------------------------


def distinct_codes(codes: Column) -> Column:
    """First-seen order."""
    return F.array_distinct(F.coalesce(codes, F.array().cast("array<string>")))


def percentile(values: Column, p: float) -> Column:
    """Element floor(n * p) of the sorted values, from 0, the last one at most; null for none.  Aggregate.

    For groups of bounded size, such as one evaluation run; see
    ``exact_percentiles`` for whole tables.
    """
    ordered = F.array_sort(F.collect_list(values))
    at = F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * F.lit(p)).cast("int"))
    return F.when(F.size(ordered) > 0, F.try_element_at(ordered, at + 1))


def exact_percentiles(rows: DataFrame, value: str, by: list[str], ps: list[float], ranges: int = 4096) -> DataFrame:
    """(by, n, p50, ...) with the same definition, over groups of any size.

    Values are counted, the counts added up by value range (at most ``ranges``
    for a group), and only the values in the ranges that hold a wanted place
    are put in order.  Null values are left out; a null group is a group.
    """
    key = F.struct(*by).alias("_key")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ends = counts.groupBy("_key").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    number = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(ranges - 1), F.floor(share * ranges).cast("int"))).otherwise(0)
    dealt = counts.join(ends, "_key").withColumn("_range", number)
    sums = dealt.groupBy("_key", "_range", "n").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))).alias("at")) for i, p in enumerate(ps)]))
    wanted = sums.withColumn("_upto", upto).withColumn("w", at).filter((F.col("_upto") > F.col("w.at")) & (F.col("_upto") - F.col("_c") <= F.col("w.at")))
    wanted = wanted.select("_key", "_range", "w.i", "w.at", (F.col("_upto") - F.col("_c")).alias("_before"))
    inside = dealt.join(wanted, ["_key", "_range"])
    run = F.sum("_c").over(Window.partitionBy("_key", "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_run", run + F.col("_before")).filter(F.col("_run") > F.col("at"))
    picks = [F.min(F.when(F.col("i") == i, F.col("_v"))).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)]
    return found.groupBy("_key", "n").agg(*picks).select("_key.*", "n", *[f"p{round(p * 100)}" for p in ps])


def reciprocal_rank(codes: Column, expected: Column) -> Column:
    at = F.array_position(F.coalesce(codes, F.array().cast("array<string>")), expected)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def gold_rows(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Gold questions with their rank facts: recall over what was retrieved, top 1 and 3 over what was ranked.

    Answers refused at the gate have no ranking, and count as an empty one.
    """
    none = F.array().cast("array<string>")
    rows = gold.join(answers, gold["id"] == answers["query_id"])
    rows = rows.withColumn("retrieved_codes", distinct_codes(F.col("retrieved_codes"))).withColumn("ranked_codes", distinct_codes(F.coalesce("ranked_codes", none)))
    return (
        rows.withColumn("recall", F.array_contains("retrieved_codes", F.col("expect")))
        .withColumn("top1", F.array_contains(F.slice("ranked_codes", 1, 1), F.col("expect")))
        .withColumn("top3", F.array_contains(F.slice("ranked_codes", 1, 3), F.col("expect")))
        .withColumn("rr", reciprocal_rank(F.col("ranked_codes"), F.col("expect")))
    )


def control_rows(controls: DataFrame, answers: DataFrame) -> DataFrame:
    """Control questions with whether they were refused: strictly, or by mention."""
    rows = controls.join(answers, controls["id"] == answers["query_id"])
    return rows.withColumn("refused_strict", is_refusal(F.col("text"))).withColumn("refused_loose", mentions_refusal(F.col("text")))


def rank_metrics(rows: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return rows.agg(F.count("*").alias("n"), share("recall"), share("top1"), share("top3"), F.avg("rr").alias("mrr"))


def accuracy(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of correct rows among those that can be scored: a fact to look for, and a judge that replied."""
    scorable = rows.filter((F.col("fact_method") != "skipped") & ~F.coalesce("judge_failed", F.lit(False)))
    return scorable.groupBy(*(by or [])).agg(F.count("*").alias("scorable"), F.count_if("correct").alias("correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def latency(rows: DataFrame) -> DataFrame:
    """p50 and p90 of the first token: raw, less waits, less rejected calls too; never below 0."""
    shape = rows.filter(F.col("first_token_ms").isNotNull()).select(
        F.explode(
            F.array(
                F.struct(F.lit("raw").alias("measure"), F.col("first_token_ms").alias("ms")),
                F.struct(F.lit("work").alias("measure"), F.greatest(F.lit(0), F.col("first_token_ms") - F.col("wait_ms")).alias("ms")),
                F.struct(F.lit("net").alias("measure"), F.greatest(F.lit(0), F.col("first_token_ms") - F.col("wait_ms") - F.col("rejected_ms")).alias("ms")),
            )
        ).alias("m")
    )
    return exact_percentiles(shape.select("m.*"), "ms", ["measure"], [0.5, 0.9])


# Judging --------------------------------------------------------------------------


def folded(frame: DataFrame, *columns: str) -> DataFrame:
    """Columns in compatibility form, which the comparison of facts starts from."""
    return frame.withColumns({c: nfkc(F.col(c)) for c in columns})


def supports_fact(rows: DataFrame, sources: DataFrame, bodies: DataFrame) -> DataFrame:
    """(query_id): answers that cite the expected document, or one whose text holds the fact (unless it is weak)."""
    cited = sources.select("query_id", "code")
    named = rows.join(cited, "query_id").filter(F.col("code") == F.col("expect")).select("query_id")
    strong = rows.filter((F.coalesce("fact", F.lit("")) != "") & ~F.coalesce("weak_fact", F.lit(False)))
    holds = strong.select("query_id", "fact").join(cited, "query_id").join(bodies.select("code", "body"), "code")
    return named.unionByName(holds.filter(contains_fact(F.col("body"), F.col("fact"))).select("query_id")).distinct()


def judge(rows: DataFrame, supported: DataFrame, make: Callable[[], LlmTransport] | None, settings: Settings = DEFAULT) -> DataFrame:
    """Verdict columns for (query_id, q, kind, fact, weak_fact, text, unverified) rows.

    No fact: skipped.  A bare refusal misses.  The fact literally in the text is
    found.  Else a model says so; without a usable reply the judge has failed.
    """
    rows = rows.join(supported.withColumn("expect_cited", F.lit(True)), "query_id", "left").withColumn("expect_cited", F.coalesce("expect_cited", F.lit(False)))
    rows = rows.withColumn("has_unverified", F.size(F.coalesce("unverified", F.array().cast("array<string>"))) > 0).withColumn("refused", is_refusal(F.col("text")))
    judged = F.when(F.col("refused"), refusal_remainder(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("judged", judged)
    strong = ~F.coalesce("weak_fact", F.lit(False))
    step = (
        F.when(F.coalesce("fact", F.lit("")) == "", "skipped")
        .when(F.col("refused") & (trim_all(F.col("judged")) == ""), "bare")
        .when(strong & contains_fact(F.col("judged"), F.col("fact")), "literal")
        .otherwise("model")
    )
    rows = rows.withColumn("_step", step)
    polar = F.trim("fact").isin("כן", "לא")
    asked = (F.lit(settings.judge_with_question) & polar) | (F.lit(settings.judge_polar_kind) & (polar | (F.col("kind") == "כן/לא")))
    rows = rows.withColumn("_asked", F.coalesce(asked, F.lit(False)))
    model = rows.filter("_step = 'model'").select("query_id", "q", "fact", "judged", "_asked")
    if make is None:
        said = model.select("query_id", F.lit(None).cast("boolean").alias("said"))
    else:
        user = F.concat(F.when(F.col("_asked"), F.concat(F.lit("Question: "), F.col("q"), F.lit("\n\n"))).otherwise(""), F.lit("Fact: "), F.col("fact"), F.lit("\n\nAnswer:\n"), F.col("judged"))
        told = replies(model, F.when(F.col("_asked"), JUDGE_ASKED).otherwise(JUDGE), user, make)
        word = trim_all(F.col("reply.text"))
        said = told.select("query_id", F.when(F.startswith(word, F.lit("כן")), True).when(F.startswith(word, F.lit("לא")), False).alias("said"))
    rows = rows.join(said, "query_id", "left")
    found = F.when(F.col("_step") == "literal", True).when(F.col("_step") == "model", F.coalesce("said", F.lit(False))).otherwise(False)
    out = rows.withColumn("fact_found", found)
    out = out.withColumn("fact_method", F.when(F.col("_step") == "skipped", "skipped").when(F.col("_step") == "model", "model").otherwise("literal"))
    out = out.withColumn("judge_failed", (F.col("_step") == "model") & F.col("said").isNull())
    return out.withColumn("correct", F.col("fact_found") & F.col("expect_cited") & ~F.col("has_unverified")).drop("_step", "_asked", "said", "judged")


# Runs -----------------------------------------------------------------------------


def failure_stage() -> Column:
    """Where a wrong answer went wrong; columns correct, retrieved_codes, ranked_codes, expect, refused, expect_cited."""
    return (
        F.when(F.col("correct"), "ok")
        .when(~F.array_contains("retrieved_codes", F.col("expect")), "search-ceiling")
        .when(~F.array_contains("ranked_codes", F.col("expect")), "ranker-dropped")
        .when(F.col("refused"), "refused-though-ranked")
        .when(~F.col("expect_cited"), "answered-cited-other")
        .otherwise("right-doc-wrong-value")
    )


def failure_shares(rows: DataFrame) -> DataFrame:
    """(stage, n, share, side) over scorable rows."""
    scorable = rows.filter((F.col("fact_method") != "skipped") & ~F.coalesce("judge_failed", F.lit(False)))
    counted = scorable.select(failure_stage().alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("t")).first()["t"] or 1
    side = F.when(F.col("stage") == "ok", "ok").when(F.col("stage").isin("search-ceiling", "ranker-dropped"), "retrieval").otherwise("answer")
    return counted.withColumn("share", F.col("n") / F.lit(total)).withColumn("side", side)


def judge_self_checks(rows: DataFrame) -> DataFrame:
    """(query_id, check): refusals whose text holds the fact, and wrong answers to weak facts."""
    strong = (F.coalesce("fact", F.lit("")) != "") & ~F.coalesce("weak_fact", F.lit(False))
    held = rows.filter((failure_stage() == "refused-though-ranked") & strong & contains_fact(F.col("text"), F.col("fact")))
    weak = rows.filter(~F.col("correct") & F.coalesce("weak_fact", F.lit(False)))
    return held.select("query_id", F.lit("refusal-holds-fact").alias("check")).unionByName(weak.select("query_id", F.lit("weak-fact-failed").alias("check")))


def validity(rows: DataFrame, expected: int, rerank_expected: Column) -> DataFrame:
    """One row: complete, stages_ran, no_failures, no_judge_failures, valid.

    rerank_expected tells of each row whether the reranker had to run for it;
    derived from the rows, so that resumed runs can be valid too.
    """
    facts = rows.agg(
        (F.count("*") == expected).alias("complete"),
        F.coalesce(F.bool_and(~rerank_expected | F.coalesce("reranked", F.lit(False))), F.lit(True)).alias("stages_ran"),
        (F.count_if(F.col("failed")) == 0).alias("no_failures"),
        (F.count_if(F.col("judge_failed")) == 0).alias("no_judge_failures"),
    )
    return facts.withColumn("valid", F.col("complete") & F.col("stages_ran") & F.col("no_failures") & F.col("no_judge_failures"))


def resume(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is left to do."""
    return todo.join(done.select(key), key, "left_anti")


def rejudged(old: DataFrame, new: DataFrame, key: str = "query_id") -> DataFrame:
    """Old rows with the newly judged ones in their place, refusal flags taken from the stored text again."""
    both = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    return both.withColumn("refused", is_refusal(F.col("text")))


def inconsistent_refusals(rows: DataFrame) -> DataFrame:
    """Rows whose recorded refusal flag contradicts their text."""
    return rows.filter(F.col("refused") != is_refusal(F.col("text")))


def stage_evidence(rows: DataFrame) -> DataFrame:
    """How often each optional stage left a trace."""
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("reranked", F.lit(False))).alias("reranked"),
        F.count_if(F.coalesce("refused", F.lit(False))).alias("refused"),
        F.count_if(F.coalesce("refused_at_gate", F.lit(False))).alias("refused_at_gate"),
        F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated"),
    )


def save_run(run: DataFrame, gold: DataFrame, controls: DataFrame, path: str) -> None:
    """A run's summary row and its detail rows, as JSON and Parquet under one folder."""
    run.write.mode("overwrite").json(f"{path}/run")
    gold.write.mode("overwrite").parquet(f"{path}/gold")
    controls.write.mode("overwrite").parquet(f"{path}/controls")


# Retry meter -----------------------------------------------------------------------


def retry_ledger(events: DataFrame) -> DataFrame:
    """call_events (query_id, stage, kind, ms, reason) -> one row per query: totals, by stage, reasons, regions."""
    wait, rejected, region = (F.col("kind") == k for k in ("wait", "rejected", "region"))
    by_stage = events.filter(~region).groupBy("query_id", "stage").agg(
        F.sum(F.when(wait, F.col("ms")).otherwise(0)).alias("wait_ms"),
        F.count_if(wait).alias("retries"),
        F.sum(F.when(rejected, F.col("ms")).otherwise(0)).alias("rejected_ms"),
        F.count_if(rejected).alias("rejected_calls"),
    )
    stages = by_stage.groupBy("query_id").agg(
        F.sum("wait_ms").alias("wait_ms"),
        F.sum("retries").alias("retries"),
        F.sum("rejected_ms").alias("rejected_ms"),
        F.sum("rejected_calls").alias("rejected_calls"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("wait_ms", "retries", "rejected_ms", "rejected_calls"))))).alias("by_stage"),
    )
    reasons = events.filter("reason <> ''").groupBy("query_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    regions = events.filter(region).groupBy("query_id", "reason").agg(F.count("*").alias("n")).groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("regions")
    )
    return events.select("query_id").distinct().join(stages, "query_id", "left").join(reasons, "query_id", "left").join(regions, "query_id", "left")


def describe_ledger(by_stage: Column) -> Column:
    """Text form of a ledger's stages."""
    one = lambda e: F.format_string(
        "%s %d x %dms + %d rejected %dms", e["key"], e["value"]["retries"], e["value"]["wait_ms"], e["value"]["rejected_calls"], e["value"]["rejected_ms"]
    )
    return F.when(F.size(by_stage) > 0, F.array_join(F.transform(F.map_entries(by_stage), one), " · ")).otherwise("none")


def wait_by_stage(rows: DataFrame) -> DataFrame:
    """(stage, wait_ms, retries) summed over answers' by_stage maps."""
    return rows.select(F.explode("by_stage").alias("stage", "v")).groupBy("stage").agg(F.sum("v.wait_ms").alias("wait_ms"), F.sum("v.retries").alias("retries"))


def calls_by_region(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("regions").alias("region", "n")).groupBy("region").agg(F.sum("n").alias("calls"))
