import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import evaluate as ev
from lodestone.operators.transports import ScriptedLlm

NO = "לא מצאתי במסמכים שברשותי"


def test_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2, None)] + [("b", 7)], "g string, v int")
    got = {r["g"]: (r["n"], r["p50"], r["p90"]) for r in ev.exact_percentiles(df, "v", ["g"], [0.5, 0.9]).collect()}
    assert got == {"a": (4, 3, 4), "b": (1, 7, 7)}
    assert df.filter("g = 'a'").agg(ev.percentile(F.col("v"), 0.5).alias("p")).first()["p"] == 3
    assert df.limit(0).agg(ev.percentile(F.col("v"), 0.5).alias("p")).first()["p"] is None


def test_rank_facts(spark):
    gold = spark.createDataFrame([("g1", "7.1"), ("g2", "7.2"), ("g3", "7.3")], "id string, expect string")
    answers = spark.createDataFrame([("g1", ["7.1", "7.1"], ["9", "9", "7.1"]), ("g2", ["7.2"], None), ("g3", ["8"], ["8"])], "query_id string, retrieved_codes array<string>, ranked_codes array<string>")
    rows = {r["id"]: r for r in ev.gold_rows(gold, answers).collect()}
    assert (rows["g1"]["recall"], rows["g1"]["top1"], rows["g1"]["top3"], rows["g1"]["rr"]) == (True, False, True, 0.5)
    assert (rows["g2"]["recall"], rows["g2"]["top3"], rows["g2"]["rr"]) == (True, False, 0.0)
    m = ev.rank_metrics(ev.gold_rows(gold, answers)).first()
    assert m["recall"] == pytest.approx(2 / 3) and m["mrr"] == pytest.approx(0.5 / 3)


def test_controls(spark):
    controls = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string")
    answers = spark.createDataFrame([("c1", NO + "."), ("c2", "yes. " + NO), ("c3", "yes")], "query_id string, text string")
    got = {r["id"]: (r["refused_strict"], r["refused_loose"]) for r in ev.control_rows(controls, answers).collect()}
    assert got == {"c1": (True, True), "c2": (False, True), "c3": (False, False)}


def test_judge(spark):
    schema = "query_id int, q string, kind string, expect string, fact string, weak_fact boolean, text string, unverified array<string>"
    rows = [
        (1, "q", "num", "7.1", "10,000", None, "it is 10000 shekels", []),
        (2, "q", "num", "7.1", None, None, "x", []),
        (3, "q", "num", "7.1", "5", None, NO + ".", []),
        (4, "q", "num", "7.1", "five", None, "say FIVE", []),
        (5, "q", "num", "7.1", "10", True, "10", ["9.9.9"]),
        (6, "q", "num", "7.1", "zzz", None, "??", []),
        (7, "q", "num", "7.1", "42", None, f"## h\n\n{NO}. but 42", []),
    ]
    df = spark.createDataFrame(rows, schema)
    sources = spark.createDataFrame([(1, "7.1"), (4, "8"), (5, "7.1"), (7, "8")], "query_id int, code string")
    bodies = spark.createDataFrame([("8", "somewhere five stands")], "code string, body string")
    supported = ev.supports_fact(df, sources, bodies)
    assert sorted(r["query_id"] for r in supported.collect()) == [1, 4, 5]
    model = lambda: ScriptedLlm(lambda s, u: "כן." if "FIVE" in u or "\n10" in u else "hm")
    got = {r["query_id"]: r for r in ev.judge(df, supported, model).collect()}
    facts = {k: (r["fact_found"], r["fact_method"], r["correct"], r["judge_failed"]) for k, r in got.items()}
    assert facts[1] == (True, "literal", True, False) and facts[2] == (False, "skipped", False, False) and facts[3] == (False, "literal", False, False)
    assert facts[4] == (True, "model", True, False) and facts[5] == (True, "model", False, False) and facts[6] == (False, "model", False, True)
    assert facts[7] == (True, "literal", False, False) and got[7]["refused"]
    assert ev.judge(df, supported, None).filter("query_id = 4").first()["judge_failed"]
    asked = ev.judge(df.filter("query_id = 4").withColumn("kind", F.lit("כן/לא")), supported, lambda: ScriptedLlm(lambda s, u: "לא" if "Question" in u else "כן"), Settings(judge_polar_kind=True))
    assert not asked.first()["fact_found"]
    acc = ev.accuracy(ev.judge(df, supported, model)).first()
    assert (acc["scorable"], acc["correct"]) == (5, 2)
    assert ev.folded(spark.createDataFrame([("ﬁ①",)], "t string"), "t").first()["t"] == "fi1"


def test_failure_stages(spark):
    schema = "query_id int, correct boolean, expect string, retrieved_codes array<string>, ranked_codes array<string>, refused boolean, expect_cited boolean, fact_method string, judge_failed boolean, fact string, weak_fact boolean, text string"
    rows = [
        (1, True, "e", [], [], False, False, "literal", False, "f", None, ""),
        (2, False, "e", ["x"], ["e"], False, False, "literal", False, "f", None, ""),
        (3, False, "e", ["e"], ["x"], False, False, "literal", False, "f", None, ""),
        (4, False, "e", ["e"], ["e"], True, True, "literal", False, "fact", None, "holds the fact"),
        (5, False, "e", ["e"], ["e"], False, False, "literal", False, "f", True, ""),
        (6, False, "e", ["e"], ["e"], False, True, "literal", False, "f", None, ""),
        (7, False, "e", ["e"], ["e"], False, True, "model", True, "f", None, ""),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["stage"]: (r["n"], r["side"]) for r in ev.failure_shares(df).collect()}
    assert got == {"ok": (1, "ok"), "search-ceiling": (1, "retrieval"), "ranker-dropped": (1, "retrieval"), "refused-though-ranked": (1, "answer"), "answered-cited-other": (1, "answer"), "right-doc-wrong-value": (1, "answer")}
    assert sorted(tuple(r) for r in ev.judge_self_checks(df).collect()) == [(4, "refusal-holds-fact"), (5, "weak-fact-failed")]


def test_runs(spark):
    rows = spark.createDataFrame([(1, True, False, False), (2, False, False, False)], "query_id int, reranked boolean, failed boolean, judge_failed boolean")
    assert ev.validity(rows, 2, F.col("query_id") == 1).first()["valid"]
    assert not ev.validity(rows, 2, F.lit(True)).first()["stages_ran"] and not ev.validity(rows, 3, F.lit(False)).first()["complete"]
    todo, done = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in ev.resume(todo, done).collect()] == ["b"]
    old = spark.createDataFrame([(1, "x", True), (2, NO, False)], "query_id int, text string, refused boolean")
    assert ev.inconsistent_refusals(old).count() == 2
    new = spark.createDataFrame([(1, NO, None)], "query_id int, text string, refused boolean")
    assert {r["query_id"]: r["refused"] for r in ev.rejudged(old, new).collect()} == {1: True, 2: True}
    assert ev.stage_evidence(old.withColumns({"reranked": F.lit(True), "refused_at_gate": F.lit(False), "truncated": F.lit(None).cast("boolean")})).first()["reranked"] == 2
    timing = spark.createDataFrame([(100, 30, 80), (50, 0, 0), (None, 1, 1)], "first_token_ms long, wait_ms long, rejected_ms long")
    assert {r["measure"]: (r["p50"], r["p90"]) for r in ev.latency(timing).collect()} == {"raw": (100, 100), "work": (70, 70), "net": (50, 50)}


def test_ledger(spark):
    rows = [(1, "rerank", "wait", 500, "Throttle"), (1, "rerank", "rejected", 20, "Throttle"), (1, "answer", "region", 0, "r1"), (1, "answer", "region", 0, "r1"), (2, "answer", "wait", 5, "")]
    ledger = ev.retry_ledger(spark.createDataFrame(rows, "query_id int, stage string, kind string, ms long, reason string"))
    got = {r["query_id"]: r for r in ledger.collect()}
    assert (got[1]["wait_ms"], got[1]["retries"], got[1]["rejected_ms"], got[1]["rejected_calls"]) == (500, 1, 20, 1) and got[1]["regions"] == {"r1": 2}
    assert ledger.filter("query_id = 1").select(ev.describe_ledger(F.col("by_stage")).alias("t")).first()["t"] == "rerank 1 x 500ms + 1 rejected 20ms"
    assert {r["stage"]: r["wait_ms"] for r in ev.wait_by_stage(ledger).collect()} == {"rerank": 500, "answer": 5}
    assert ev.calls_by_region(ledger).first()["calls"] == 2
