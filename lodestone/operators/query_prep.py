"""Question variants: translation where languages differ, and vocabulary expansion."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions.text import is_hebrew, trim_all, ws
from lodestone.operators.transports import CallEvent, LlmTransport, generate
from lodestone.sources.shared import cut

TRANSLATE = (
    "Rewrite the user's question as a short search query in the target language, in the words of official documentation. "
    "Keep product and service names as they are. Reply with the query alone."
)
EXPAND = "Say the question in the words of the regulations, twice, one version a line, about as long as the question. Add no subject to it."


def valid_questions(questions: DataFrame) -> DataFrame:
    """Questions of 3 to 500 characters and at most 8 chosen topics."""
    codes = F.coalesce(F.size("topic_codes"), F.lit(0)) if "topic_codes" in questions.columns else F.lit(0)
    return questions.filter(F.length(trim_all(F.col("question"))).between(3, 500) & (codes <= 8))


def unquoted(reply: Column) -> Column:
    return F.regexp_replace(trim_all(reply), r"^[\"'`]|[\"'`]$", "")


def usable_translation(reply: Column, settings: Settings = DEFAULT) -> Column:
    """The translation a reply holds, null if it can't be used."""
    text = unquoted(reply)
    return F.when((text != "") & (F.length(text) <= settings.query_chars), text)


def usable_rewrites(reply: Column, question: Column, settings: Settings = DEFAULT) -> Column:
    """At most two rewrites: of fair length, not the question itself, not much longer than it."""
    lines = F.transform(F.split(reply, r"\r?\n"), lambda x: trim_all(unquoted(F.regexp_replace(x, ws(r"^[0-9.\-•*\s]+"), ""))))
    most = F.greatest(F.lit(60), F.floor(F.length(question) * 1.4 + 0.5).cast("int"))
    good = F.filter(lines, lambda x: F.length(x).between(8, settings.query_chars) & (x != question) & (F.length(x) <= most))
    return F.slice(good, 1, 2)


EVENTS = "array<struct<stage:string,kind:string,ms:long,reason:string>>"
_REPLY = f"text string, error string, input_tokens long, output_tokens long, stop_reason string, first_token_ms long, total_ms long, events {EVENTS}"


def replies(
    frame: DataFrame, system: Column, user: Column, make: Callable[[], LlmTransport], name: str = "reply", stage: str = "answer", attempts: int = 3
) -> DataFrame:
    """One model call per row, timed; a failed call leaves a null reply and the error's name.

    The replies are written to the shared folder before they are used: what
    reads them doesn't call the model again, and all of a row's columns come
    from the same reply.  ``events`` holds the row's waits, rejected calls and
    regions (see ``evaluate.retry_ledger``).
    """

    @F.pandas_udf(_REPLY)
    def call(systems: pd.Series, users: pd.Series) -> pd.DataFrame:
        transport = make()
        rows = []
        for s, u in zip(systems, users):
            log: list[CallEvent] = []
            began = time.monotonic()
            try:
                r = generate(transport, s, u, stage, attempts, log.append)
                took = int((time.monotonic() - began) * 1000)
                told = (r.text, None, r.input_tokens, r.output_tokens, r.stop_reason, took if r.first_token_ms is None else r.first_token_ms, took)
            except Exception as e:  # noqa: BLE001  reported in the row
                told = (None, type(e).__name__, 0, 0, None, None, int((time.monotonic() - began) * 1000))
            rows.append((*told, [(e.stage, e.kind, e.ms, e.reason) for e in log]))
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _REPLY.split(", ")])

    return cut(frame.withColumn(name, call.asNondeterministic()(system, user)))


def prepare(questions: DataFrame, collections: DataFrame, make: Callable[[], LlmTransport] | None, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, question, collection) -> (query_id, variant, text): the question, then its translation or rewrites.

    A failed or unusable reply leaves the question alone.  Without a model only
    the question is returned.
    """
    language = collections.select(F.col("id").alias("collection"), "language")
    asked = questions.join(language, "collection", "left").withColumn("asked", F.when(is_hebrew(F.col("question")), "he").otherwise("en"))
    own = asked.select("query_id", F.lit(0).alias("variant"), F.col("question").alias("text"))
    if make is None:
        return own
    other = asked.filter(F.col("asked") != F.coalesce("language", F.lit("he")))
    target = F.when(F.col("language") == "he", "Hebrew").otherwise("English")
    user = F.concat(F.lit("Target language: "), target, F.lit("\nQuestion: "), F.col("question"))
    told = replies(other, F.lit(TRANSLATE), user, make)
    out = own.unionByName(
        told.select("query_id", F.lit(1).alias("variant"), usable_translation(F.col("reply.text"), settings).alias("text")).filter(F.col("text").isNotNull())
    )
    if settings.query_expansion:
        same = asked.filter(F.col("asked") == F.coalesce("language", F.lit("he")))
        told = replies(same, F.lit(EXPAND), F.col("question"), make)
        rewrites = F.posexplode(usable_rewrites(F.col("reply.text"), F.col("question"), settings)).alias("_n", "text")
        out = out.unionByName(told.select("query_id", rewrites).select("query_id", (F.col("_n") + 1).alias("variant"), "text"))
    return out
