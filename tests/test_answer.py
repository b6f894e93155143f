import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.config import Settings
from lodestone.operators import answer, clarify, evaluate, feedback, query_prep, rerank
from lodestone.operators.transports import (
    CallEvent, DailyLimit, Embedded, HashTransport, HttpError, ScriptedLlm, embed_all, embed_error, embed_transport, generate, is_retryable, llm_transport,
)
from lodestone.sources.collections import Collection

HIT = "query_id int, pos int, collection string, code string, id string, index int, title string, text string, score double, lexical boolean, named boolean"


def hits(spark, rows):
    """(pos, code, score[, lexical[, named]]) rows of query 1."""
    full = [(1, r[0], "c", r[1], f"{r[1]}#0", 0, f"Title {r[1]}", f"text of {r[1]}", r[2], *(tuple(r[3:]) + (False, False))[:2]) for r in rows]
    return spark.createDataFrame(full, HIT)


# Rerank


@pytest.mark.parametrize(("reply", "order"), [("[3, 1, 3, 9, 0]", [3, 1]), ("x [2] y [1]", [2]), ("none", []), ("[]", []), ("[a]", [])])
def test_parse_order(spark, reply, order):
    assert spark.range(1).select(rerank.parse_order(F.lit(reply), F.lit(3)).alias("o")).first()["o"] == order


def test_rerank(spark):
    rows = hits(spark, [(1, "a", 0.9), (2, "n", 0.1, False, True), (3, "b", 0.8), (4, "c", 0.7), (5, "l", 0.6, True)])
    asked = spark.createDataFrame([(1, "q?")], "query_id int, question string")
    run = lambda reply: rerank.rerank(asked, rows, lambda: ScriptedLlm(lambda s, u: reply), Settings(top_k=2)).orderBy("pos").collect()
    assert [r["code"] for r in run("[3, 1]")] == ["n", "c", "a", "l"]
    kept = run("no array")
    assert [r["code"] for r in kept] == ["a", "n", "b", "c", "l"] and kept[0]["rerank_reason"] == "unparseable"

    def broken(s, u):
        raise HttpError(400, "bad")

    failed = rerank.rerank(asked, rows, lambda: ScriptedLlm(broken)).collect()
    assert len(failed) == 5 and failed[0]["rerank_reason"] == "failed"
    one = rerank.rerank(asked, hits(spark, [(1, "a", 0.9)]), lambda: ScriptedLlm(lambda s, u: "[1]")).collect()
    assert one[0]["rerank_reason"] == "nothing-to-rank" and not one[0]["reranked"]


# Clarify and feedback


def test_topics_merge_like_titles(spark):
    rows = [(1, 1, "a", "Purchase of goods", 0.9, False), (1, 2, "a", "Purchase of goods", 0.5, False), (1, 3, "b", "Purchase of goods abroad", 0.8, False),
            (1, 4, "c", "Travel", 0.7, False), (1, 5, "d", "Loans", 0.6, False), (1, 6, "e", "Travel abroad", 0.5, False), (1, 7, "f", "Housing", 0.4, False), (1, 8, "g", "Zoo", 0.99, True)]
    df = spark.createDataFrame(rows, "query_id int, pos int, code string, title string, score double, lexical boolean")
    got = clarify.topics(df).orderBy("topic").collect()
    assert [(t["label"], t["codes"]) for t in got] == [("Purchase of goods", ["a", "b"]), ("Travel", ["c", "e"]), ("Loans", ["d"])]
    decide = lambda **k: clarify.decide(df, clarify.topics(df, Settings(**k)), F.lit(0.3), Settings(**k)).first()["decision"]
    assert decide() == "refuse" and decide(clarify_min_score=0.5) == "answer" and decide(clarify_min_score=0.5, clarify_always=True) == "clarify"
    questions = spark.createDataFrame([(1, "q")], "query_id int, question string")
    record = clarify.clarification(questions, clarify.topics(df)).first()["clarification"]
    assert record["none_label"] == clarify.NONE_OF_THESE and len(record["topics"]) == 3


def test_same_topic(spark):
    same = lambda a, b: spark.range(1).select(clarify.same_topic(F.lit(a), F.lit(b)).alias("s")).first()["s"]
    assert same('הוראות מע"מ', "הוראות מעמ") and same("one two three", "zzz one two three") and same("alpha beta gamma delta", "gamma beta alpha omega")
    assert not same("alpha beta", "beta gamma")


def test_feedback(spark, tmp_path):
    path = f"{tmp_path}/feedback"
    assert feedback.load(spark, path).count() == 0
    one = spark.createDataFrame([("q", [1.0, 0.0], ["7.1"], "l", "c"), ("r", [0.0, 1.0], ["7.2"], "l", "d")], "q string, vector array<double>, codes array<string>, label string, collection string")
    feedback.record(one, path)
    feedback.record(one, path)
    known = feedback.load(spark, path)
    assert known.count() == 4 and feedback.export_labels(known).columns == ["q", "codes", "label", "at"]
    asked = spark.createDataFrame([(1, "c", [0.99, 0.1]), (2, "c", [0.0, 1.0]), (3, "x", [1.0, 0.0])], "query_id int, collection string, vector array<double>")
    got = {r["query_id"]: r for r in feedback.recall(asked, known.withColumn("ord", F.monotonically_increasing_id())).collect()}
    assert got[1]["matched"] and got[1]["codes"] == ["7.1"] and not got[2]["matched"] and got[3]["similarity"] == 0


# Query preparation


def test_prepare(spark):
    known = spark.createDataFrame([("he", "he"), ("en", "en")], "id string, language string")
    asked = spark.createDataFrame([(1, "what is this", "he"), (2, "what is that", "en"), (3, "מה זה בכלל", "he")], "query_id int, question string, collection string")
    make = lambda: ScriptedLlm(lambda s, u: '"תרגום"' if "Hebrew" in u else "1. first way to say it\n2. מה זה בכלל\nx\nsecond way to say it\nthird way of it")
    rows = lambda m, s=Settings(): [tuple(r) for r in query_prep.prepare(asked, known, m, s).orderBy("query_id", "variant").collect()]
    assert rows(None) == [(1, 0, "what is this"), (2, 0, "what is that"), (3, 0, "מה זה בכלל")]
    assert rows(make)[1] == (1, 1, "תרגום") and len(rows(make)) == 4
    assert rows(make, Settings(query_expansion=True))[-2:] == [(3, 1, "first way to say it"), (3, 2, "second way to say it")]
    assert query_prep.valid_questions(spark.createDataFrame([("ab",), ("abc",), ("x" * 501,)], "question string")).count() == 1


# Citations


def test_citations_and_quotes(spark):
    quote = "the minimum amount is one hundred shekels"
    answers = spark.createDataFrame([(1, f'לפי הוראה 7.6.1. "{quote}" וגם הוראה 9.9.9 והוראה 7.6.1.4 והוראה 7.100.1')], "query_id int, text string")
    schema = "query_id int, pos int, collection string, code string, title string, text string, score double"
    passages = spark.createDataFrame([(1, 1, "c", "7.6.1", "A", "nothing", 0.2), (1, 2, "c", "7.6.1", "A", "more 9.9.9", 0.7), (1, 3, "c", "7.7", "B", f"so **{quote}** it is", 0.5)], schema)
    cited = answer.cited_hits(answers, passages, F.lit("instruction"))
    assert [(r["code"], r["score"]) for r in cited.collect()] == [("7.6.1", 0.7)]
    assert [r["code"] for r in answer.unverified_codes(answers, passages).collect()] == ["9.9.9"]
    assert answer.unverified_codes(answers, passages, allow_passages=True).count() == 0
    assert [r["code"] for r in answer.quoted_documents(answers, cited, passages).collect()] == ["7.7"]
    assert answer.quoted_hits(answers, cited, passages).count() == 0


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(answer.truncated(F.lit("max_tokens"))) and not one(answer.truncated(F.lit(None).cast("string")))
    assert one(answer.cost(F.lit(1_000_000), F.lit(100_000), F.lit(1.0), F.lit(5.0))) == 1.5
    assert one(answer.quote_check_verdict(F.lit(" עונה."))) == "answers" and one(answer.quote_check_verdict(F.lit("?"))) == "failed"
    assert one(answer.quote_check_prompt(F.lit("first\n\nrest of it"))) == "rest of it"
    he, en = answer.system_prompt(Collection("a")), answer.system_prompt(Collection("b", language="en", citation="page"), Settings(concise=True))
    assert answer.REFUSAL_TEXT in he and "Translate" in en and "200 words" in en and "Translate" not in he


def test_user_message_and_topic_choice(spark):
    rows = hits(spark, [(1, "7.1", 0.9), (2, "7.2", 0.8)]).withColumn("keywords", F.array(F.lit("k1"), F.lit("k2"))).withColumn("doctype", F.lit("Form"))
    asked = spark.createDataFrame([(1, "why?", ["7.2"])], "query_id int, question string, topic_codes array<string>")
    message = answer.user_messages(asked, rows).first()["message"]
    assert message.startswith('[1] מתוך טופס 7.1 — "Title 7.1":\nמילות מפתח רשמיות: k1, k2\ntext of 7.1\n\n[2]') and "7.1, 7.2" in message and message.endswith("why?")
    assert [r["code"] for r in answer.choose_topics(rows, asked).collect()] == ["7.2"]
    assert answer.choose_topics(rows, asked.withColumn("topic_codes", F.array(F.lit("none")))).count() == 2


def test_ask(spark):
    chunks = hits(spark, [(1, "7.1", 0.9), (2, "7.2", 0.8)]).select("collection", "id", "code", "title", "index", "text", F.lit(None).cast("array<string>").alias("keywords"), F.lit("Instruction").alias("doctype"))
    found = hits(spark, [(1, "7.1", 0.99), (2, "7.2", 0.8)]).unionByName(hits(spark, [(1, "7.2", 0.1)]).withColumn("query_id", F.lit(2)))
    found = found.unionByName(hits(spark, [(1, "7.1", 0.5)]).withColumn("query_id", F.lit(3)))
    asked = spark.createDataFrame([(1, "how much?"), (2, "off topic?"), (3, "refused one?")], "query_id int, question string")

    def reply(system, user):
        if "Rank" in system:
            return "[2, 1]"
        return answer.REFUSAL_TEXT if "refused" in user else "It is 5 (הוראה 7.1) but see הוראה 8.8.8."

    out = {r["query_id"]: r for r in answer.ask(asked, found, chunks, Collection("c"), lambda: ScriptedLlm(reply)).collect()}
    assert [s["code"] for s in out[1]["sources"]] == ["7.1"] and out[1]["unverified"] == ["8.8.8"] and out[1]["ranked"] == ["7.2", "7.1"] and out[1]["reranked"]
    assert not out[1]["refused"] and out[1]["cost_usd"] > 0
    assert out[2]["refused_at_gate"] and out[2]["text"] == answer.REFUSAL_TEXT and out[2]["cost_usd"] == 0
    assert out[3]["refused"] and not out[3]["refused_at_gate"] and out[3]["sources"] == []
    asks_back = answer.ask(asked.filter("query_id = 1"), found, chunks, Collection("c"), lambda: ScriptedLlm(reply), Settings(clarify_min_score=0.5, clarify_always=True)).first()
    assert asks_back["text"] == answer.CLARIFY_TEXT and len(asks_back["clarification"]["topics"]) == 2 and not asks_back["refused"]


def test_each_call_is_made_once(spark, tmp_path):
    chunks = hits(spark, [(1, "7.1", 0.9), (2, "7.2", 0.8)]).select("collection", "id", "code", "title", "index", "text", F.lit(None).cast("array<string>").alias("keywords"), F.lit("Form").alias("doctype"))
    found = hits(spark, [(1, "7.1", 0.99), (2, "7.2", 0.8)])
    asked = spark.createDataFrame([(1, "how much?")], "query_id int, question string")

    def reply(system, user):
        stage = "rerank" if "Rank" in system else "check" if system == answer.QUOTE_CHECK else "answer"
        first = not list(tmp_path.glob(f"{stage}-*"))
        (tmp_path / f"{stage}-{uuid.uuid4().hex}").touch()
        if stage == "answer" and first:
            raise HttpError(429, "slow down")
        return {"rerank": "[2, 1]", "check": "עונה"}.get(stage, f'{answer.REFUSAL_TEXT}\n\nבהוראה 7.1 כתוב "text of 7.1 that is long enough"')

    long = chunks.withColumn("text", F.concat("text", F.lit(" that is long enough")))
    own = Settings(refusal_keeps_quoted=True, refusal_quote_check=True, refusal_offers_topics=True, sources_add_quoted=True)
    out = answer.ask(asked, found, long, Collection("c"), lambda: ScriptedLlm(reply), own)
    row = out.collect()[0]
    assert out.count() == 1
    made = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert sorted(made) == ["answer", "answer", "check", "rerank"]  # the first answer call was rejected
    assert row["wait_ms"] == 500 and row["total_ms"] >= 500 and row["first_token_ms"] is not None
    events = [(r["stage"], r["kind"]) for r in answer.call_events(out).collect()]
    assert events == [("answer", "rejected"), ("answer", "wait")]
    ledger = evaluate.retry_ledger(answer.call_events(out)).first()
    assert ledger["wait_ms"] == 500 and ledger["by_stage"]["answer"]["retries"] == 1
    alone = answer.ask(asked, found, long, Collection("c"), lambda: ScriptedLlm(lambda s, u: "x"), Settings(rerank=False)).first()
    assert row["input_tokens"] > alone["input_tokens"] > 0


class Endpoint(BaseHTTPRequestHandler):
    """A chat-completions and embeddings endpoint of its own."""

    def log_message(self, *args):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        if self.headers["Authorization"] != "Bearer k":
            self.send_error(401)
            return
        self.send_response(200)
        self.end_headers()
        if "input" in body:
            data = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))], "usage": {"prompt_tokens": 3}}
            self.wfile.write(json.dumps(data).encode())
        elif body.get("stream"):
            for piece in ("It is ", "5 (הוראה 7.2)."):
                self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': piece}}]})}\n\n".encode())
            self.wfile.write(b'data: {"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}\n\ndata: [DONE]\n\n')
        else:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "whole"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 1}}).encode())


@pytest.fixture(scope="module")
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_transports(endpoint):
    llm = llm_transport("http", url=endpoint, model="m", key="k")
    assert list(llm.stream("s", "u")) == ["It is ", "5 (הוראה 7.2)."] and llm.last.output_tokens == 2 and llm.last.first_token_ms is not None
    assert llm_transport("http", url=endpoint, model="m", key="k", streaming=False).generate("s", "u").stop_reason == "length"
    out = embed_all(embed_transport("http", url=endpoint, model="m", key="k", dims=2), ["a", "bcd"], "query")
    assert out.vectors == [[1.0, 1.0], [3.0, 1.0]] and out.tokens == 3
    with pytest.raises(HttpError):
        llm_transport("http", url=endpoint, model="m", key="wrong").generate("s", "u")
    with pytest.raises(ValueError):
        llm_transport("http", url=endpoint, model="m")
    log = []
    two = llm_transport("http", model="m", key="k", regions={"north": endpoint, "south": endpoint})
    for _ in range(3):
        generate(two, "s", "u", log=log.append)
    assert [(e.kind, e.reason) for e in log] == [("region", "north"), ("region", "south"), ("region", "north")]


def test_cli_asks_an_endpoint(spark, endpoint, tmp_path, monkeypatch, capsys):
    folder = tmp_path / "docs" / "c"
    folder.mkdir(parents=True)
    (folder / "H.7.1.md").write_text("# Goods\n\nRules for goods.")
    (folder / "H.7.2.txt").write_text("Travel rules")
    common = ["--index", f"file://{tmp_path}/index", "--collection", "c"]
    cli.main(["ingest", *common, "--docs", f"file://{tmp_path}/docs"])
    capsys.readouterr()
    monkeypatch.setenv("OWN_KEY", "k")
    cli.main(["ask", *common, "--llm", "http", "--llm-url", endpoint, "--llm-model", "m", "--llm-key-env", "OWN_KEY", "travel rules 7.2"])
    said = json.loads(capsys.readouterr().out)
    assert said["text"] == "It is 5 (הוראה 7.2)." and [s["code"] for s in said["sources"]] == ["7.2"] and said["input_tokens"] >= 7


def test_pacing_and_warning():
    pauses = []
    assert len(embed_all(HashTransport(4), ["a"] * 5, "document", 2, pause=0.25, sleep=pauses.append).vectors) == 5 and pauses == [0.25, 0.25]
    with pytest.warns(UserWarning, match="1 of 2 texts"):
        embed_all(HashTransport(4), ["a", "b" * 40_000], "document")


def test_ask_refusals_that_quote(spark):
    quote = "the text of the rule that decides this matter"
    rows = hits(spark, [(1, "7.1", 0.9), (2, "7.2", 0.8)]).withColumn("text", F.concat(F.lit("x "), F.lit(quote), F.lit(" "), F.col("code")))
    chunks = rows.select("collection", "id", "code", "title", "index", "text", F.lit(None).cast("array<string>").alias("keywords"), F.lit("Form").alias("doctype"))
    asked = spark.createDataFrame([(1, "how much?")], "query_id int, question string")

    def run(verdict, **more):
        def reply(system, user):
            if system == answer.QUOTE_CHECK:
                return verdict
            return f'{answer.REFUSAL_TEXT}\n\nבהוראה 7.1 כתוב "{quote}"'

        return answer.ask(asked, rows, chunks, Collection("c"), lambda: ScriptedLlm(reply), Settings(rerank=False, refusal_keeps_quoted=True, **more)).first()

    assert [s["code"] for s in run("")["sources"]] == ["7.1"]
    assert [s["code"] for s in run("עונה", refusal_quote_check=True)["sources"]] == ["7.1"]
    out = run("מסביר", refusal_quote_check=True, refusal_offers_topics=True)
    assert out["sources"] == [] and out["refused"] and len(out["clarification"]["topics"]) == 2


# Transports


def test_retries():
    waits, log, calls = [], [], []

    class Flaky:
        id = model = "flaky"

        def generate(self, system, user):
            calls.append(1)
            if len(calls) < 3:
                raise HttpError(429, "slow down")
            return ScriptedLlm(lambda s, u: "ok").generate(system, user)

    assert generate(Flaky(), "s", "u", log=log.append, sleep=waits.append).text == "ok" and waits == [0.5, 1.0]
    assert [e.kind for e in log] == ["rejected", "wait"] * 2 and isinstance(log[0], CallEvent)
    assert is_retryable(TimeoutError()) and is_retryable(HttpError(503, "")) and not is_retryable(HttpError(401, "")) and not is_retryable(ValueError())
    assert embed_error(RuntimeError("too many tokens per day")) == "daily-ceiling" and embed_error(HttpError(403, "")) == "other" and embed_error(RuntimeError("x")) == "throttle"


def test_embedding():
    t = HashTransport(16)
    out = embed_all(t, ["a b", "a b", "c"] * 50, "document", 7)
    assert len(out.vectors) == 150 and out.vectors[0] == out.vectors[1] and json.dumps(out.vectors[0])
    with pytest.raises(ValueError):
        embed_all(t, ["x" * 60_000], "document")

    class Short(HashTransport):
        def embed(self, texts, purpose):
            return Embedded([])

    with pytest.raises(ValueError):
        embed_all(Short(), ["a"], "document")

    class Daily(HashTransport):
        def embed(self, texts, purpose):
            raise RuntimeError("daily token quota")

    with pytest.raises(DailyLimit):
        embed_all(Daily(), ["a"], "query", sleep=lambda s: None)
    assert embed_transport("hash").id == "hash"
    for f in (embed_transport, llm_transport):
        with pytest.raises(KeyError):
            f("nowhere")
