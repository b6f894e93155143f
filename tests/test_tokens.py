"""Tokens counted over Arrow batches are those of the Column expressions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.tokens import Tokens
from lodestone.operators import lexical


def _texts(n: int) -> list[str]:
    rng = random.Random(4)
    parts = ["Ab", "c", "_", "7", "7.6", ".", "..", "ה", "וכש", "לכש", "מכרז", "של", "את", "ם", "ץ", "״", "׳", "שָׁ", "־", "İ", "K", "é", "-", " ", " ", " ", "\n", "﻿", "٣"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_counts_are_those_of_the_expressions(spark):
    said = _texts(1500)
    rows = spark.createDataFrame(list(enumerate(said)), "ord long, text string").select("ord", text.tokenise(F.col("text")).alias("t")).collect()
    want = {r["ord"]: Counter(r["t"]) for r in rows}
    asked = frozenset(random.Random(1).sample(sorted({t for c in want.values() for t in c}), 40))
    tokens = Tokens(asked)
    for i, x in enumerate(said):
        assert tokens.count(x) == want[i], x
        assert tokens.count_asked(x) == (want[i].total(), {t: n for t, n in want[i].items() if t in asked}), x


def test_rows_with_keys_of_their_own_are_not_shuffled(spark):
    docs = spark.range(50).select(F.col("id").alias("ord"), F.lit("one two Two").alias("text"))
    found = lexical.postings(docs, F.col("text"), ["ord"])
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["term"], r["tf"], r["length"]) for r in found.collect()} == {("one", 1, 3), ("two", 2, 3)}


def test_rows_that_share_their_keys_are_one(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "two three"), (2, "two"), (None, "six"), (None, "six"), (3, "")], "ord long, text string")
    found = {tuple(r) for r in lexical.postings(docs, F.col("text"), ["ord"]).select("ord", "term", "tf", "length").collect()}
    assert found == {(1, "one", 1, 4), (1, "two", 2, 4), (1, "three", 1, 4), (2, "two", 1, 1), (None, "six", 2, 2)}
    asked = spark.createDataFrame([("two",), ("three",)], "term string")
    rows = lexical.asked_terms(docs, F.col("text"), ["ord"], asked).collect()
    assert {(r["ord"], r["length"], tuple(tuple(t) for t in r["terms"])) for r in rows} == {(1, 4, (("three", 1), ("two", 2))), (2, 1, (("two", 1),)), (None, 2, ())}
