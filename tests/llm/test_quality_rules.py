import re

import duckdb

from lodestone.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    cov = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cov)


TEXTS = ["", " \n\t ", "a b c d e f a b c d e", "x\x0by\x1cz  é ü 漢字 🙂", "l one\nl one\n\n \nl one", "# * $ %%% <|>", "w " * 30, "a b c d e " * 3 + "q", "l\r\nl\r\nl"]


def test_measures():
    for t in TEXTS:
        assert qr.measures(t.encode()) == brute(t), t


def test_same_as_sql_and_host_verdict(spark, tmp_path):
    rows = [(i, t, "h") for i, t in enumerate(TEXTS)] + [(50, None, None), (50, None, None), (None, "x " * 9, "h")]
    good = "one two three four five six seven eight nine ten eleven number{}"
    rows += [(100 + i, good.format(i), f"g{i % 20}") for i in range(400)]
    rows += [(1000 + i, "junk junk", "bad") for i in range(50)] + [(2000, good.format("x"), "bad"), (2001, "few words", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {(r["doc_id"], r["n_words"]): r for r in qr.judged(docs).collect()}
    assert not out[(2000, 12)]["kept"] and not out[(2000, 12)]["base_failed"]
    assert all(out[(100 + i, 12)]["kept"] for i in range(400))
    verdicts = {r["host"]: r for r in qr.host_verdicts(qr.measured(docs)).collect()}
    assert verdicts["bad"]["rejected"] and verdicts["tiny"]["rate_few_words"] < 1
    docs.write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(map(str, c.execute(qr.SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in qr.judged(docs).collect()) == want
    assert qr.judged(docs.limit(0)).count() == 0
    assert 2000 not in {r["doc_id"] for r in qr.keep_good(docs).collect()}
