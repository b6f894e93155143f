import random

import math

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import lexical, retrieve
from lodestone.operators.dense import dense_topk, pair_scores, same_space

CHUNK = "ord long, collection string, id string, code string, title string, index int, text string, keywords array<string>, doctype string, source_url string, embedding array<float>"


def chunk(o, code, index, text, vector, collection="c", title=None):
    return (o, collection, f"{code}#{index}", code, title or code, index, text, None, None, None, vector)


@pytest.fixture(scope="module")
def corpus(spark):
    table = "a\tb\tc\td\te\tsalary table senior adviser"
    rows = [
        chunk(0, "7.1", 0, "purchase of goods", [1.0, 0.0, 0.0]),
        chunk(1, "7.1", 1, "purchase of services", [0.9, 0.1, 0.0]),
        chunk(2, "7.1", 2, "purchase committee", [0.8, 0.2, 0.0]),
        chunk(3, "7.2", 0, "travel abroad zebra", [0.0, 1.0, 0.0]),
        chunk(4, "7.3", 0, table, [0.0, 0.0, 1.0]),
        chunk(5, "7.4", 0, "no vector zebra zebra", None),
        chunk(6, "7.5", 0, "zero vector", [0.0, 0.0, 0.0]),
        chunk(7, "7.6", 0, "wrong width", [1.0]),
    ]
    return spark.createDataFrame(rows, CHUNK).cache()


def asked(spark, text, vector=(1.0, 0.0, 0.0), q=1):
    return spark.createDataFrame([(q, 0, text, list(vector))], "query_id long, variant int, text string, vector array<double>")


def test_dense_skips_odd_vectors_and_keeps_ties_in_order(spark, corpus):
    two = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "query_id long, vector array<double>")
    got = dense_topk(corpus, two, 5, block=1).orderBy("query_id", "rank").collect()
    assert [r["ord"] for r in got if r["query_id"] == 1] == [0, 1, 2, 3, 4]
    assert [(r["ord"], r["score"]) for r in got if r["query_id"] == 2][:2] == [(3, 1.0), (4, 1.0)]
    all_rows = dense_topk(corpus, two, 9).filter("query_id = 1").orderBy("rank").collect()
    assert [r["ord"] for r in all_rows][-1] == 6 and all_rows[-1]["score"] == -1 and len(all_rows) == 6
    pairs = spark.createDataFrame([(1, 1), (1, 5), (1, 6), (1, 7)], "query_id long, ord long")
    scores = {r["ord"]: r["score"] for r in pair_scores(pairs, corpus, two).collect()}
    assert scores[1] == pytest.approx(0.9 / math.sqrt(0.82), 1e-6) and scores[5] is None and scores[6] == -1 and scores[7] is None


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "apple apple pear"), (1, "pear"), (2, "plum fig"), (3, None)], "ord long, text string")
    queries = spark.createDataFrame([(1, "apple pear apple"), (2, "none")], "query_id long, text string")
    got = {r["ord"]: r["score"] for r in lexical.bm25(docs, F.col("text"), queries, 5).collect()}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.5))
    assert got == pytest.approx({0: idf(1) * part(2, 3) + idf(2) * part(1, 3), 1: idf(2) * part(1, 1)})


def test_rrf_ties_go_to_the_first_seen(spark):
    lists = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (1, 2, 2, "b")], "query_id int, list int, pos int, k string")
    assert [r["k"] for r in lexical.rrf(lists, ["k"]).orderBy("rank").collect()] == ["b", "a", "c"]


def test_diversify_backfills(spark, corpus):
    hits = corpus.filter("ord < 4").select(F.lit(1).alias("query_id"), "ord", "collection", "code")
    pick = lambda k: [r["ord"] for r in retrieve.diversify(hits, k, 2, ["collection", "code"], [F.col("ord")]).orderBy("ord").collect()]
    assert pick(3) == [0, 1, 3] and pick(4) == [0, 1, 2, 3] and pick(9) == [0, 1, 2, 3]


def test_hybrid_brings_in_words_and_named_codes(spark, corpus):
    hits = retrieve.retrieve(asked(spark, "what says 7.4 of zebra"), corpus, 4).orderBy("pos").collect()
    by_code = {h["code"]: h for h in hits}
    assert by_code["7.4"]["named"] and not by_code["7.4"]["lexical"]
    plain = {h["code"]: h for h in retrieve.retrieve(asked(spark, "zebra"), corpus, 4).collect()}
    assert plain["7.4"]["lexical"] and not plain["7.2"]["lexical"] and plain["7.4"]["score"] == 0
    assert len([h for h in hits if h["code"] == "7.1"]) <= 2


def test_table_assist_appends_flagged_rows(spark, corpus):
    hits = retrieve.retrieve(asked(spark, "table of senior adviser?"), corpus, 2, Settings(hybrid_search=False)).orderBy("pos").collect()
    assert [(h["ord"], h["lexical"]) for h in hits] == [(0, False), (1, False), (4, True)]
    none = retrieve.retrieve(asked(spark, "senior adviser"), corpus, 2, Settings(hybrid_search=False, table_assist=False))
    assert none.count() == 2


def test_union_puts_named_first(spark, corpus):
    hits = retrieve.retrieve_union(asked(spark, "see 7.2 zebra"), corpus, 3).orderBy("pos").collect()
    assert hits[0]["code"] == "7.2" and hits[0]["named"]


def test_merge_of_collections(spark):
    schema = "query_id int, pos int, collection string, id string, ord long, code string, score double, lexical boolean, named boolean, fused_rank int"
    rows = [(1, 1, "a", "x#0", 0, "x", 0.5, False, False, 0), (1, 2, "a", "y#0", 1, "y", 0.2, False, True, 1), (1, 1, "b", "z#0", 2, "z", 0.9, False, False, 0), (1, 2, "b", "w#0", 3, "w", 0.1, True, False, None)]
    got = retrieve.merge_collections(spark.createDataFrame(rows, schema), 3).orderBy("pos").collect()
    assert [g["code"] for g in got] == ["y", "z", "x", "w"]


def test_across(spark, corpus):
    other = corpus.withColumn("collection", F.lit("d")).withColumn("ord", F.col("ord") + 100)
    both = corpus.unionByName(other)
    queries = asked(spark, "zebra").withColumn("embed_transport", F.lit("t"))
    meta = lambda *rows: spark.createDataFrame(rows, "collection string, embed_transport string, embed_model string, dims int")
    one = retrieve.retrieve_across(queries, both, meta(("c", "t", "m", 3), ("d", "t", "m", 3)), 4).collect()
    assert {h["collection"] for h in one} == {"c", "d"}
    apart = retrieve.retrieve_across(queries, both, meta(("c", "t", "m", 3), ("d", "u", "m", 3)), 4).collect()
    assert {h["collection"] for h in apart} == {"c"} and [h["pos"] for h in apart] == list(range(1, len(apart) + 1))
    with pytest.raises(ValueError):
        retrieve.retrieve_across(queries, both, spark.createDataFrame([], "collection string, embed_transport string, embed_model string, dims int"), 4)


def test_gate(spark):
    rows = [(1, 0.2, False, False), (1, 0.9, True, False), (2, 0.31, False, False), (3, 0.0, False, True), (4, 0.9, True, False)]
    hits = spark.createDataFrame(rows, "query_id int, score double, lexical boolean, named boolean")
    assert {r["query_id"]: r["confident"] for r in retrieve.confident(hits, F.lit(0.3)).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_parent_vote(spark):
    schema = "query_id int, pos int, collection string, code string, id string, score double, lexical boolean, named boolean"
    codes = ["a", "b", "c", "b", "d"]
    rows = [(1, i + 1, "c", code, f"{code}#{i}", 0.5 + i / 10, False, False) for i, code in enumerate(codes)]
    rows += [(1, 6, "c", "n", "n#0", 0.1, False, True), (1, 7, "c", "l", "l#0", 0.1, True, False), (2, 1, "c", "a", "a#0", 0.5, False, False), (2, 2, "c", "d", "d#1", 0.4, False, False)]
    totals = spark.createDataFrame([("c", "b", 3), ("c", "a", 9)], "collection string, code string, total long")
    got = retrieve.parent_vote(spark.createDataFrame(rows, schema), totals, Settings(parent_vote=True)).orderBy("query_id", "pos").collect()
    assert [g["id"] for g in got if g["query_id"] == 1] == ["n#0", "b#3", "a#0", "c#2", "d#4", "l#0"]
    assert next(g["merged"] for g in got if g["id"] == "b#3") == ["b#1", "b#3"]
    assert [(g["id"], g["pos"], g["applied"]) for g in got if g["query_id"] == 2] == [("a#0", 1, False), ("d#1", 2, False)]


@pytest.fixture(scope="module")
def book(spark):
    rows = [("c", code, f"{code}#{i}", i, code.upper(), f"{code}{i} " + "x" * 96) for code, n in (("short", 2), ("long", 12)) for i in range(n)]
    return spark.createDataFrame(rows, "collection string, code string, id string, index int, title string, text string").cache()


def hit_rows(spark, book, ids):
    rows = [(1, i + 1, d, 0.9 - i / 10) for i, d in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id int, pos int, id string, score double").join(book, "id").withColumn("lexical", F.lit(False))


def test_parent_context(spark, book):
    hits = hit_rows(spark, book, ["short#1", "long#6"])
    got = retrieve.parent_context(hits, book, Settings(parent_context_chars=1000)).orderBy("pos").collect()
    assert [g["id"] for g in got] == ["short#0", "short#1", "long#0", "long#1", "long#5", "long#6"]
    assert [g["score"] for g in got] == [0, 0.9, 0, 0, 0, 0.8]
    assert got[4]["text"].startswith(retrieve.GAP) and got[5]["text"].endswith(retrieve.GAP) and not got[3]["text"].startswith(retrieve.GAP)
    whole = retrieve.parent_context(hits, book, Settings(parent_context_chars=24000)).orderBy("pos").collect()
    assert len(whole) == 14 and not any(retrieve.GAP in w["text"] for w in whole)
    slack = retrieve.parent_context(hit_rows(spark, book, ["long#3"]), book, Settings(parent_context_chars=1000, parent_slack=0.5)).collect()
    assert len(slack) == 12


def simulated(hits, docs, budget, slack, radius):
    """(id, gap before, gap behind) of one query's passages; hits: (doc, place, lexical), docs: name -> chunk sizes."""
    order = list(dict.fromkeys(d for d, _, lexical in hits if not lexical))
    out, left = [], budget
    for rank, d in enumerate(order):
        sizes = docs[d]
        if sum(sizes) <= left or (rank == 0 and slack and sum(sizes) <= budget * (1 + slack)):
            left = max(0, left - sum(sizes))
            out += [(f"{d}#{i}", False, False) for i in range(len(sizes))]
            continue
        cap, found = left // 2, {i for e, i, _ in hits if e == d}
        picked, used = [], 0
        for i, size in enumerate(sizes):
            head = sum(sizes[: i + 1]) <= cap * 0.6
            beside = any(abs(i - j) <= radius for j in found)
            if (head or beside) and (i in found or used + size <= cap):
                picked.append(i)
                used += size
        out += [(f"{d}#{i}", i != (picked[k - 1] + 1 if k else 0), k == len(picked) - 1 and i < len(sizes) - 1) for k, i in enumerate(picked)]
        left -= used
    seen = {x[0] for x in out}
    return out + [(f"{d}#{i}", False, False) for d, i, _ in hits if f"{d}#{i}" not in seen]


def test_parent_context_against_simulation(spark):
    rng = random.Random(6)
    docs = {f"d{k}": [rng.randint(20, 300) for _ in range(rng.randint(1, 14))] for k in range(12)}
    rows = [("c", d, f"{d}#{i}", i, d, "x" * n) for d, sizes in docs.items() for i, n in enumerate(sizes)]
    chunks = spark.createDataFrame(rows, "collection string, code string, id string, index int, title string, text string").cache()
    asked = {}
    for q in range(40):
        every = [(d, i) for d, sizes in docs.items() for i in range(len(sizes))]
        asked[q] = [(d, i, rng.random() < 0.15) for d, i in rng.sample(every, rng.randint(1, 8))]
    found = [(q, n + 1, d, i, lex) for q, hits in asked.items() for n, (d, i, lex) in enumerate(hits)]
    places = spark.createDataFrame(found, "query_id int, pos int, code string, index int, lexical boolean")
    hits = places.join(chunks, ["code", "index"]).withColumn("score", F.lit(0.5))
    for budget, slack, radius in ((1500, 0.0, 1), (900, 0.4, 2), (100_000, 0.0, 1)):
        own = Settings(parent_context_chars=budget, parent_slack=slack, neighbour_radius=radius)
        got = {}
        for r in retrieve.parent_context(hits, chunks, own).orderBy("query_id", "pos").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["text"].startswith(retrieve.GAP), r["text"].endswith(retrieve.GAP)))
        assert got == {q: simulated(h, docs, budget, slack, radius) for q, h in asked.items()}


def test_neighbours(spark, book):
    got = retrieve.neighbours(hit_rows(spark, book, ["long#6", "short#0", "long#7"]), book, 1).orderBy("pos").collect()
    assert [(g["id"], round(g["score"], 1)) for g in got] == [("long#5", 0), ("long#6", 0.9), ("long#7", 0.7), ("long#8", 0), ("short#0", 0.8), ("short#1", 0)]


def test_spaces(spark):
    left = spark.createDataFrame([("a", "m", "t", 3), ("b", "old", "t", 3), ("c", "m", "t", 4), ("d", "", "t", 3)], "collection string, embed_model string, embed_transport string, dims int")
    right = spark.createDataFrame([("m", "t", 3)], "embed_model string, embed_transport string, dims int")
    assert {r["collection"]: r["comparable"] for r in same_space(left, right).collect()} == {"a": True, "b": False, "c": False, "d": True}
    assert not retrieve.one_space(left).first()["same_space"]


def test_no_table_row_meets_a_phrase(spark, monkeypatch):
    """Rows of one document with the same words are one before they are joined, so that a frequent pair takes no more memory than a rare one."""
    rows = [(i, "c", f"d{i % 3}", "\t".join([str(i), "large ring nr1", "a", "b", "c", "end"])) for i in range(300)]
    chunks = spark.createDataFrame(rows, "ord long, collection string, code string, text string")
    met, matches = [], retrieve._matches

    def seen(phrases, pairs):
        met.append(pairs.count())
        return matches(phrases, pairs)

    monkeypatch.setattr(retrieve, "_matches", seen)
    asked = spark.createDataFrame([(1, "what says the large ring nr1?"), (2, "a ring nr2")], "query_id long, text string")
    found = {tuple(r) for r in retrieve.rare_phrases(asked, chunks).select("query_id", "phrase").collect()}
    assert found == {(1, "large ring"), (1, "ring nr1")}
    assert met == [6]
    held = retrieve._holding(asked.select(F.lit("arge ring").alias("phrase")).distinct(), chunks)
    assert held.count() == 300


def test_a_task_holds_one_tile_and_gives_each_query_k_rows(monkeypatch):
    """However many batches a task reads, it returns the best k once, and no more than a tile is scored at a time."""
    import numpy as np

    from lodestone.operators import dense

    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(900, 8)), rng.normal(size=(6, 8))
    vectors[500:600] = vectors[:100]  # ties
    vectors[7] = 0
    monkeypatch.setattr(dense, "TILE_SCORES", 200)
    sizes, tile = [], dense._Best._tile
    monkeypatch.setattr(dense._Best, "_tile", lambda self, own, ords: (sizes.append(len(ords) * len(self.unit)), tile(self, own, ords))[1])
    first = np.array([0, 2, 3, 4])  # the first and the last query have two and two variants
    best = dense._Best(["a", "b", "c", "d"], first, dense._unit(asked), 5)
    for part in np.array_split(np.arange(900), 7):
        best.add(dense._unit(vectors[part]), part)
    assert max(sizes) <= 200
    got = [r for b in best.rows(dense.pa.string()) for r in b.to_pylist()]
    scores = np.maximum.reduceat(np.nan_to_num(np.round(dense._unit(asked) @ dense._unit(vectors).T, 12), nan=-1.0), first, axis=0)
    for q, name in enumerate("abcd"):
        want = np.lexsort((np.arange(900), -scores[q]))[:5]
        assert [r["ord"] for r in got if r["query_id"] == name] == want.tolist()
    assert len(got) == 20
