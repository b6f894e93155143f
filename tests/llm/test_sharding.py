import hashlib
import random
import zlib

import pytest

from lodestone.llm import sharding


def brute(sizes, shards):
    def need(c):
        n, left = 1, c
        for s in sizes:
            if s > left:
                n, left = n + 1, c
            left -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if need(m) <= shards else (m + 1, high)
    return low


@pytest.mark.parametrize("digits", [1, 3])
def test_smallest_capacity(spark, monkeypatch, digits):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rng = random.Random(4)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), rng.choice([1, 5, 40, 900])) for i in range(400)]
    groups = spark.createDataFrame(rows, "digest string, bytes long").cache()
    capacity, cuts = sharding.minimax_cuts(groups, 7)
    assert capacity == brute([b for _, b in sorted(rows)], 7)
    loads = [0] * 7
    for d, b in rows:
        loads[sum(d >= c for c in cuts)] += b
    assert max(loads) == capacity


def test_documents(spark):
    rng = random.Random(9)
    texts = [f"text {i} " * rng.randint(0, 30) + "é" for i in range(500)] + [None, "", "hot copy " * 30]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1000 + i, "hot copy " * 30, 2) for i in range(300)] + [(5, texts[5], 1), (None, "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shard_documents(docs, 8).collect()
    assert len(out) == len(rows)
    shard_of = {}
    by_shard = {}
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in out) == want
    for r in out:
        assert shard_of.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = {}
    for d, t, _ in rows:
        k = hashlib.sha256((t or "").encode()).hexdigest()
        sizes[k] = sizes.get(k, 0) + len((t or "").encode()) + 1
    load = {}
    for r in out:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) == brute([sizes[k] for k in sorted(sizes)], 8)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
