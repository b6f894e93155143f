"""The pipeline's stages against brute force, each on what the one before kept."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodestone.llm import decontaminate, pii, quality_classifier, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_and_counts(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    counts = [s.count() for s in stages]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] == counts[5] > 0 and counts[0] > counts[2]


def test_quality(spark, stages):
    model = quality_classifier.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in stages[0].collect() if model.score([quality_classifier.features(r["text"].encode())])[0] >= 0.3}
    assert {r["doc_id"] for r in stages[1].collect()} == good


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(stages):
    rows = [(r["doc_id"], grams(r["text"])) for r in stages[1].collect()]
    least = {d: d for d, _ in rows}
    near = [(d, e) for i, (d, a) in enumerate(rows) for e, b in rows[:i] if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for d, e in near:
            if least[d] != least[e]:
                least[d] = least[e] = min(least[d], least[e])
                changed = True
    assert {r["doc_id"] for r in stages[2].collect()} == set(least.values())


def test_edge_rows_pass_every_stage(spark):
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()]
    rows = [(i, t, "en", "s", len(t), 0.5, "x") for i, t in enumerate(good)]
    rows += [(50, None, None, None, None, None, None), (51, "", "en", "s", 0, 1.0, ""), (None, good[0], "en", "s", 1, 1.0, ""), (None, None, "en", "s", 1, 1.0, "")]
    rows += [rows[3], (52, good[4] + " " + "word " * 60_000, "en", "s", 1, 1.0, ""), (3, good[5] + " and more", "en", "s", 1, 1.0, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"
    docs = spark.createDataFrame(rows, schema)
    for empty in (False, True):
        kept = docs.limit(0) if empty else docs
        for name, stage in cp.STAGES:
            before, kept = kept, stage(spark, kept, SF).cache()
            n, m = before.count(), kept.count()
            assert m <= n and (m == n or name in ("quality", "near_duplicates", "decontamination")) and bool(m) != empty, name
            assert kept.columns[: len(docs.columns)] == docs.columns


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own = decontaminate.Templates(items)
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert {r["doc_id"] for r in stages[3].collect()} == {d for d, t in before.items() if not own.match(t)}
    assert not any(i in r["text"] for r in stages[3].collect() for _, i in items)


def test_personal_data_and_encoding(stages):
    model = pii.judge()
    after = {r["doc_id"]: r for r in stages[4].collect()}
    for r in stages[3].collect():
        want = pii.redact(r["text"], pii.all_spans(r["text"], model)[1])
        assert after[r["doc_id"]]["text"] == want and after[r["doc_id"]]["n_chars"] == len(want)
        assert not pii.base_spans(want)
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages[5].collect():
        assert r["text"] == after[r["doc_id"]]["text"] and r["lang"] == after[r["doc_id"]]["lang"] and len(r["ids"]) == r["n_tokens"]
        ids = lib.encode(after[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)


SHAPES = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op4_substring_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


def test_run_and_queries(spark, stages):
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))
    sizes = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in queries.queries().items():
        df = query(spark, SF)
        n = df.count()
        if name in SHAPES:
            assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == SHAPES[name], name
            assert n == sizes["pages" if name == "op2_html_text" else "documents"], name


def test_classifier_query(spark):
    out = {r["doc_id"]: r for r in queries.op10_quality_classifier(spark, SF).collect()}
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = quality_classifier.fit(docs, labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    again = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, other).collect()}
    assert again == {d: r["score"] for d, r in out.items()}  # held-out labels don't count
