import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from lodestone.llm import shingles


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    sets = [grams(t) for _, t in rows]
    least = [d for d, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    return set(least)


def test_stage_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=30))
    base = [" ".join(rng.choices(words, k=rng.randint(30, 150))) for _ in range(40)]
    rows = []
    for i in range(200):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t) + (" " + shared if rng.random() < 0.5 else "")))
    rows += [(900, None), (901, ""), (902, "one Two"), (903, "ONE two"), (904, "a b c " * 3000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows + rows[:3]], "doc_id long, text string, n_chars int")
    got = {r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()}
    assert got == kept(rows)
    assert {r["doc_id"] for r in shingles.keep_one(docs.limit(0)).collect()} == set()


def test_stage_on_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()} == want


def test_large_groups_meet_in_tiles(monkeypatch):
    monkeypatch.setattr(shingles, "TILE", 7)
    zero = pa.array(np.zeros(50, int))
    bits = pa.array([bytes(shingles.BITMAP // 8)] * 50, pa.binary())
    root = np.arange(50) // 5 * 5  # five sets each are linked already
    columns = [zero, zero, zero, pa.array(np.full(50, -1)), pa.array(np.arange(50)), pa.array(root), pa.array(np.full(50, 20)), zero, bits]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "g", "h", "side", "digest", "root", "n", "place", "bits"])
    found = [p for b in shingles._cross_pairs(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(found) == [(i, j) for i in range(50) for j in range(i + 1, 50) if i // 5 != j // 5]


def test_a_large_group_is_dealt_and_not_paired_out(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=80)
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = shingles._signatures(docs, np.zeros(0, np.int64)).cache()
    prints = ids.selectExpr("digest", "doc_id AS least", "n", "prefix", "bits").dropDuplicates(["digest"]).cache()
    links = shingles.similar_links(docs, prints, tile_rows=16)
    of = {r["digest"]: r["doc_id"] for r in ids.collect()}
    pairs = [(of[r["a"]], of[r["b"]]) for r in links.collect()]
    assert len(pairs) < 150 * 12
    least = dict.fromkeys(of.values())
    least = {d: d for d in least}
    for _ in range(200):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert set(least.values()) == kept(rows)
