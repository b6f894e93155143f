"""Answers: prompts in, checked answers out; every check is a join over many answers at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions.text import cites, codes_claimed, is_refusal, normalise_quote, quoted_spans, refusal_remainder, trim_all
from lodestone.operators import clarify, rerank
from lodestone.operators.query_prep import EVENTS, replies
from lodestone.operators.retrieve import chunks_per_doc, confident, neighbours, parent_context, parent_vote
from lodestone.operators.transports import LlmTransport
from lodestone.sources.collections import Collection
from lodestone.sources.shared import cut

REFUSAL_TEXT = "לא מצאתי במסמכים שברשותי."
CLARIFY_TEXT = "לא ברור לי למה התכוונת. איזה מהנושאים האלה?"
QUOTE_CHECK = "Does the text itself answer the question from the rules it quotes? Reply with one word: עונה if it does, מסביר if it explains that the rules are about something else."
#: Names of document kinds (fixed values).
KINDS = {
    "Instruction": "הוראה",
    "Form": "טופס",
    "Message": "הודעה",
    "Tender Notice": "הודעת מכרז",
    "Tender Details": "פרטי מכרז",
    "Tender Maintenance": "עדכון מכרז",
    "Attached File": "נספח",
}


# Prompts ------------------------------------------------------------------------


def system_prompt(collection: Collection, settings: Settings = DEFAULT) -> str:
    """Rules for the model, by how the collection is cited and its language."""
    subject = "regulations" if collection.citation == "instruction" else "product documentation"
    cite = "(הוראה 7.6.1)" if collection.citation == "instruction" else "(עמוד NAME)"
    rules = [
        f"You help to find information in {subject}. Answer in Hebrew, from the attached passages only.",
        f'If the passages hold no answer, write exactly: "{REFUSAL_TEXT}" If they answer in part, give that part and say what is missing.',
        f"Name the source of every statement as its passage names it, like {cite}.",
        "Invent no sums, rates, dates or names. Say so where passages contradict each other.",
        "Give every threshold, sum, condition, exception and approver that bears on the question; quote numbers and dates as they are.",
        "Keep each value of a table with its column.",
    ]
    if settings.answer_applicability:
        rules.append("A rule, definition or prohibition from which the answer follows is an answer; refuse only where there is no ground at all.")
    if collection.language != "he":
        rules.append("Translate into fluent Hebrew; leave names of services, parameters and commands in English.")
    if settings.answer_scope_first and collection.citation == "instruction":
        rules.append("If the rule applies to another body than the question's, open with what it applies to.")
    if settings.concise:
        rules.append("Be brief: about 200 words, no headings, no summary; keep every citation.")
    return "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))


def user_messages(questions: DataFrame, passages: DataFrame, citation: str = "instruction", labels: dict[str, str] | None = None) -> DataFrame:
    """(query_id, message): numbered passages, the codes that may be cited, the question."""
    kind = F.coalesce(*[F.when(F.col("doctype") == k, F.lit(v)) for k, v in KINDS.items()], F.lit(KINDS["Instruction"]))
    several = F.size(F.collect_set("collection").over(Window.partitionBy("query_id"))) > 1
    label = F.coalesce(*[F.when(F.col("collection") == k, F.lit(v)) for k, v in (labels or {}).items()], F.col("collection"))
    page = F.concat(F.lit("מתוך עמוד התיעוד "), F.col("code"), F.when(several, F.concat(F.lit(" של "), label)).otherwise(""))
    source = F.concat(F.lit("מתוך "), kind, F.lit(" "), F.col("code")) if citation == "instruction" else page
    words = F.when(F.size("keywords") > 0, F.concat(F.lit("\nמילות מפתח רשמיות: "), F.array_join("keywords", ", "))).otherwise("")
    entry = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), source, F.lit(' — "'), F.col("title"), F.lit('":'), words, F.lit("\n"), F.col("text"))
    rows = passages.withColumn("_e", entry).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_e", "code"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["_e"]), "\n\n")
    allowed = F.array_join(F.array_distinct(F.transform("p", lambda x: x["code"])), ", ")
    joined = questions.select("query_id", "question").join(rows, "query_id")
    message = F.concat(body, F.lit("\n\n---\nCite only: "), allowed, F.lit("\nQuestion: "), F.col("question"))
    return joined.select("query_id", message.alias("message"))


# Citations ----------------------------------------------------------------------


def cited_hits(answers: DataFrame, passages: DataFrame, citation: Column) -> DataFrame:
    """(query_id, code, title, score, pos): documents that the answer names, with their best score, in passage order."""
    own = Window.partitionBy("query_id", "code")
    docs = passages.withColumn("_best", F.greatest(F.lit(0.0), F.max("score").over(own))).withColumn("_n", F.row_number().over(own.orderBy("pos"))).filter("_n = 1")
    named = docs.join(answers.select("query_id", F.col("text").alias("_answer")), "query_id").filter(cites(F.col("_answer"), F.col("code"), citation))
    return named.select("query_id", "code", "title", F.col("_best").alias("score"), "pos")


def _bodies(passages: DataFrame) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: F.coalesce(p["text"], F.lit("")))
    return passages.groupBy("query_id", "collection", "code").agg(
        normalise_quote(F.array_join(parts, "\n")).alias("body"), F.max("score").alias("score"), F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos")
    )


def _spans(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", F.explode(quoted_spans(F.col("text"))).alias("span")).distinct()


def quoted_hits(answers: DataFrame, cited: DataFrame, passages: DataFrame) -> DataFrame:
    """Cited documents whose passages hold one of the answer's quotations; cited: (query_id, code, ...)."""
    holds = _bodies(passages).join(_spans(answers), "query_id").filter(F.contains("body", F.col("span")))
    return cited.join(holds.select("query_id", "code").distinct(), ["query_id", "code"], "left_semi")


def quoted_documents(answers: DataFrame, cited: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, collection, code, title, score): documents that are quoted, by a span no cited document holds, but not cited."""
    bodies = _bodies(passages).join(cited.select("query_id", "code", F.lit(True).alias("cited")).distinct(), ["query_id", "code"], "left")
    holds = bodies.join(_spans(answers), "query_id").filter(F.contains("body", F.col("span")))
    own = holds.filter("cited").select("query_id", "span").distinct()
    other = holds.filter(F.col("cited").isNull()).join(own, ["query_id", "span"], "left_anti")
    return other.select("query_id", "collection", "code", "title", "score").distinct()


def unverified_codes(answers: DataFrame, passages: DataFrame, allow_passages: bool = False) -> DataFrame:
    """(query_id, code) of instructions that the answer names and that no passage comes from.

    Codes of fewer than three parts or with a part of more than two digits are
    no instructions; a code above or below a retrieved one is known; with
    ``allow_passages`` so is one that a passage's text names.
    """
    claimed = answers.select("query_id", F.explode(codes_claimed(F.col("text"))).alias("code")).distinct()
    parts = F.split("code", r"\.")
    claimed = claimed.filter((F.size(parts) >= 3) & F.forall(parts, lambda p: F.length(p) <= 2))
    known = passages.select("query_id", F.col("code").alias("known")).distinct()
    dot = lambda c: F.concat(c, F.lit("."))
    near = (F.col("code") == F.col("known")) | F.startswith("known", dot(F.col("code"))) | F.startswith("code", dot(F.col("known")))
    out = claimed.join(claimed.join(known, "query_id").filter(near).select("query_id", "code"), ["query_id", "code"], "left_anti")
    if allow_passages:
        named = out.join(passages.select("query_id", F.col("text").alias("_t")), "query_id").filter(cites(F.col("_t"), F.col("code"), F.lit("instruction")))
        out = out.join(named.select("query_id", "code").distinct(), ["query_id", "code"], "left_anti")
    return out


def truncated(stop_reason: Column) -> Column:
    return F.coalesce(stop_reason.isin("max_tokens", "length"), F.lit(False))


def cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Price per million tokens."""
    return input_tokens / F.lit(1e6) * price_in + output_tokens / F.lit(1e6) * price_out


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows (route, input_tokens, output_tokens) with their cost by route."""
    return usage.join(prices.select("route", "price_in", "price_out"), "route", "left").withColumn(
        "cost_usd", cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"))
    )


def choose_topics(hits: DataFrame, choices: DataFrame) -> DataFrame:
    """Hits limited to the chosen topics' codes; a query without a choice, or whose choice hits nothing, keeps its list."""
    chosen = choices.select("query_id", F.explode("topic_codes").alias("code")).distinct().withColumn("_chosen", F.lit(1))
    rows = hits.join(chosen, ["query_id", "code"], "left")
    some = F.max("_chosen").over(Window.partitionBy("query_id"))
    return rows.withColumn("_some", some).filter(F.col("_some").isNull() | F.col("_chosen").isNotNull()).drop("_chosen", "_some")


def quote_check_prompt(text: Column) -> Column:
    """What a refusal goes on to say after its first line, for the check of whether it answers after all."""
    return trim_all(F.regexp_replace(trim_all(text), r"^[^\n]*\n*", ""))


def quote_check_verdict(reply: Column) -> Column:
    """answers, explains or failed."""
    return F.when(F.startswith(trim_all(reply), F.lit("עונה")), "answers").when(F.startswith(trim_all(reply), F.lit("מסביר")), "explains").otherwise("failed")


# The whole way -------------------------------------------------------------------


def sources(answers: DataFrame, hits: DataFrame, passages: DataFrame, citation: str, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, code, title, score, pos): what each answer rests on.

    Cited documents; for refusals none, or the quoted ones if set so; an answer
    that cites nothing rests on the first hit.
    """
    flagged = answers.withColumn("_answered", (trim_all(F.col("text")) != "") & ~is_refusal(F.col("text")))
    cited = cited_hits(answers, passages, F.lit(citation))
    good = flagged.filter("_answered").select("query_id")
    kept = cited.join(good, "query_id", "left_semi")
    if settings.refusal_keeps_quoted:
        kept = kept.unionByName(quoted_hits(answers, cited.join(good, "query_id", "left_anti"), passages))
    bare = good.join(kept.select("query_id").distinct(), "query_id", "left_anti")
    first = hits.join(bare, "query_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter("_n = 1")
    out = kept.unionByName(first.select("query_id", "code", "title", "score", "pos"))
    if settings.sources_add_quoted:
        extra = quoted_documents(answers.join(good, "query_id", "left_semi"), out, passages)
        out = out.unionByName(extra.select("query_id", "code", "title", "score", F.lit(1 << 20).alias("pos")))
    return out


def _refusal_checks(questions: DataFrame, answers: DataFrame, own: DataFrame, make: Callable[[], LlmTransport]) -> DataFrame:
    """(query_id, reply) for refusals that name sources: does the text answer after all?"""
    refused = answers.filter(is_refusal(F.col("text"))).join(own.select("query_id").distinct(), "query_id", "left_semi")
    rows = refused.select("query_id", "text").join(questions.select("query_id", "question"), "query_id")
    user = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nText:\n"), quote_check_prompt(F.col("text")))
    return replies(rows, F.lit(QUOTE_CHECK), user, make, stage="quote-check").select("query_id", "reply")


def _checked_sources(own: DataFrame, told: DataFrame) -> DataFrame:
    """Sources without those of refusals that a model doesn't find to answer after all."""
    dropped = told.filter(F.coalesce(quote_check_verdict(F.col("reply.text")), F.lit("failed")) != "answers").select("query_id")
    return own.join(dropped, "query_id", "left_anti")


def _usage(calls: list[DataFrame]) -> DataFrame:
    """(query_id, input_tokens, output_tokens, wait_ms, rejected_ms, call_events) over all model calls of a query."""
    rows = calls[0].select("query_id", "reply")
    for c in calls[1:]:
        rows = rows.unionByName(c.select("query_id", "reply"))
    events = F.flatten(F.collect_list("reply.events"))
    spent = lambda kind: F.aggregate(F.filter("call_events", lambda e: e["kind"] == kind), F.lit(0).cast("long"), lambda s, e: s + e["ms"])
    total = rows.groupBy("query_id").agg(F.sum("reply.input_tokens").alias("input_tokens"), F.sum("reply.output_tokens").alias("output_tokens"), events.alias("call_events"))
    return total.withColumn("wait_ms", spent("wait")).withColumn("rejected_ms", spent("rejected"))


def ask(questions: DataFrame, hits: DataFrame, chunks: DataFrame, collection: Collection, make: Callable[[], LlmTransport], settings: Settings = DEFAULT) -> DataFrame:
    """Questions (query_id, question[, topic_codes]) and their hits to checked answers, one row each.

    Gate and clarification read the hits before votes and reranking; questions
    that stop there never reach the model.  Every model call of a question is
    made once (see ``replies``); tokens, cost, waits and events are those of all
    its calls, reranking and checks included.
    """
    threshold = F.lit(settings.min_score.get(collection.language, settings.min_score["he"]))
    chosen = F.coalesce(F.size("topic_codes") > 0, F.lit(False)) if "topic_codes" in questions.columns else F.lit(False)
    asked = questions.withColumn("_chosen", chosen)
    if "topic_codes" in questions.columns:
        hits = choose_topics(hits, asked.filter("_chosen"))
    retrieved = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code", "title", "score"))), lambda h: F.struct(h["code"].alias("code"), h["title"].alias("title"), h["score"].alias("score"))).alias("retrieved"))
    found = cut(clarify.topics(hits, settings))
    gate = asked.join(confident(hits, threshold), "query_id", "left").join(clarify.decide(hits, found, threshold, settings), "query_id", "left")
    state = (
        F.when(F.col("_chosen"), "go")
        .when(F.col("decision") == "clarify", "clarify")
        .when(~F.coalesce("confident", F.lit(False)), "gate")
        .otherwise("go")
    )
    gate = cut(gate.select("query_id", "question", state.alias("state")))
    going = gate.filter("state = 'go'")
    live = hits.join(going.select("query_id"), "query_id", "left_semi")
    if settings.parent_vote:
        live = parent_vote(live, chunks_per_doc(chunks), settings).drop("applied")
    calls = []
    if settings.rerank:
        calls.append(rerank.asked(going, live, make, settings))
        ranked = rerank.ordered(live, calls[-1], settings)
    else:
        ranked = live.withColumn("reranked", F.lit(False)).withColumn("rerank_reason", F.lit("off"))
    detail = chunks.select("collection", "id", "title", "keywords", "doctype")
    if settings.parent_context:
        passages = parent_context(ranked, chunks, settings).drop("title").join(detail, ["collection", "id"], "left")
    else:
        passages = neighbours(ranked, chunks, settings.neighbour_radius).join(detail, ["collection", "id"], "left")
    ranked, passages = cut(ranked), cut(passages)  # each is read by many branches below
    told = replies(user_messages(going, passages, collection.citation), F.lit(system_prompt(collection, settings)), F.col("message"), make, attempts=settings.generate_attempts)
    calls.append(told)
    answers = told.select("query_id", F.col("reply.text").alias("text"), F.col("reply.error").alias("error"), "reply.first_token_ms", "reply.total_ms", truncated(F.col("reply.stop_reason")).alias("truncated"))
    own = sources(answers, ranked, passages, collection.citation, settings)
    if settings.refusal_quote_check:
        calls.append(_refusal_checks(going, answers, own, make))
        own = _checked_sources(own, calls[-1])
    own = cut(own)
    listed = own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code", "title", "score"))), lambda h: F.struct(h["code"].alias("code"), h["title"].alias("title"), h["score"].alias("score"))).alias("sources"))
    doubtful = unverified_codes(answers, passages, settings.unverified_allows_passages).groupBy("query_id").agg(F.array_sort(F.collect_list("code")).alias("unverified"))
    order = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda h: h["code"]).alias("ranked"), F.max("reranked").alias("reranked"), F.max("rerank_reason").alias("rerank_reason"))
    asks = gate.filter("state = 'clarify'").select("query_id", "question")
    if settings.refusal_offers_topics:  # a refusal over several hits offers their topics too
        several = ranked.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1").select("query_id")
        no = answers.filter(is_refusal(F.col("text")) | (trim_all(F.col("text")) == "")).join(several, "query_id", "left_semi")
        asks = asks.unionByName(going.join(no.select("query_id"), "query_id", "left_semi").select("query_id", "question"))
    record = clarify.clarification(asks, found)
    out = gate.join(answers, "query_id", "left").join(_usage(calls), "query_id", "left").join(listed, "query_id", "left").join(doubtful, "query_id", "left").join(order, "query_id", "left").join(retrieved, "query_id", "left").join(record, "query_id", "left")
    text = F.when(F.col("state") == "gate", REFUSAL_TEXT).when(F.col("state") == "clarify", CLARIFY_TEXT).otherwise(F.col("text"))
    answered = (F.col("state") == "go") & (trim_all(F.coalesce("text", F.lit(""))) != "") & ~is_refusal(F.coalesce("text", F.lit("")))
    return out.select(
        "query_id",
        "question",
        text.alias("text"),
        ((F.col("state") != "clarify") & ~answered).alias("refused"),
        (F.col("state") == "gate").alias("refused_at_gate"),
        F.coalesce("sources", F.array().cast("array<struct<code:string,title:string,score:double>>")).alias("sources"),
        "retrieved",
        "ranked",
        F.coalesce("unverified", F.array().cast("array<string>")).alias("unverified"),
        "truncated",
        "reranked",
        "rerank_reason",
        "clarification",
        "error",
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
        cost(F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)), F.lit(settings.price.price_in), F.lit(settings.price.price_out)).alias("cost_usd"),
        "first_token_ms",
        "total_ms",
        F.coalesce("wait_ms", F.lit(0)).alias("wait_ms"),
        F.coalesce("rejected_ms", F.lit(0)).alias("rejected_ms"),
        F.coalesce("call_events", F.array().cast(EVENTS)).alias("call_events"),
    )


def call_events(answers: DataFrame) -> DataFrame:
    """(query_id, stage, kind, ms, reason): the events of answers, one row each, as ``evaluate.retry_ledger`` reads them."""
    return answers.select("query_id", F.explode("call_events").alias("e")).select("query_id", "e.*")


__all__ = [
    "ask", "call_events", "cited_hits", "choose_topics", "cost", "quoted_documents", "quoted_hits", "quote_check_prompt", "quote_check_verdict", "refusal_remainder",
    "sources", "system_prompt", "truncated", "unverified_codes", "user_messages", "with_cost",
]
