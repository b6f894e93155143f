import zlib

import numpy as np
import pytest

from lodestone.llm import gam, quality_classifier as qc

SF = "/root/testdata/sf0.1"


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    model = gam.PairwiseGam().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    assert (0, 1) in model.pair_tables


def test_degenerate_fits():
    assert gam.PairwiseGam().fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (gam.PairwiseGam().fit(np.ones((9, 2)), np.ones(9)).score(np.ones((1, 2))) > 0.9).all()


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = qc.fit(docs, labels, 3000)
    return docs, labels, model, {r["doc_id"]: r["score"] for r in qc.score(docs, model).collect()}


def test_held_out_accuracy(spark, scored):
    docs, labels, model, score = scored
    held = [(r["quality"], score[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == (y == 1) for y, s in held]) > 0.97


def test_model_does_not_depend_on_row_order(spark, scored):
    docs, labels, model, score = scored
    again = qc.fit(docs.repartition(7), labels.orderBy("quality"), 3000)
    assert np.allclose(again.intercept, model.intercept)
    assert all(np.allclose(a, b) for a, b in zip(again.tables, model.tables))


def test_edge_rows_and_filter(spark, scored):
    _, labels, model, _ = scored
    rows = [(1, None, "x", 0.1), (1, "", "x", 0.1), (None, "word " * 40000, "y", 0.2), (3, "Thing of the and", "z", 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score double")
    assert len([r for r in qc.score(docs, model).collect() if 0 <= r["score"] <= 1]) == 4
    kept = qc.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 0
    assert qc.score(docs.limit(0), model).count() == 0
    assert qc.fit(docs.select("doc_id", "text"), labels.limit(0)).score(np.zeros((1, len(qc.FEATURES))))[0] == 0.5
