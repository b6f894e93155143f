import random

import numpy as np
import xxhash

from lodestone.llm import simhash


def brute_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(d, brute_print(t or "")) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, p, least[find(i)]) for i, (d, p) in enumerate(prints))


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(40, 200))) for _ in range(40)]
    rows = []
    for i in range(240):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "one Two"), (903, "ONE two"), (904, "a b c " * 30000), (905, "ÉA x")]
    rows += rows[:3]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted((r[0], r[1] & (2**64 - 1), r[2]) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute(rows)})


def test_every_bucket_is_tiled():
    rng = random.Random(2)
    prints, bucket = [], []
    for b, size in enumerate([1, 2, 2, 700, 3, 1, 40]):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
            bucket.append(b)
    fp, bucket = np.array(prints, dtype=np.uint64), np.array(bucket)
    want = {(i, j) for i in range(len(fp)) for j in range(i) if bucket[i] == bucket[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    got = [(int(max(x, y)), int(min(x, y))) for a, b in simhash.close_pairs(fp, bucket, 3, tile=16) for x, y in zip(a, b)]
    assert set(got) == want and len(got) == len(want)


def test_rows_are_kept_by_text(spark):
    unique = "quite another text that nothing else in here is like at all"
    rows = [(1, "a b c d e", 1), (2, "a b c d e", 2), (2, unique, 3), (2, unique, 3), (None, "a b c d e", 4), (None, "x y z", 5), (None, "x y z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_mark int")
    for keep in (simhash.keep_one, simhash.keep_similar):
        assert sorted((tuple(r)[:2] for r in keep(docs.drop("_row_mark")).collect()), key=str) == [(1, "a b c d e"), (2, unique), (None, "x y z")]
        assert keep(docs.limit(0)).count() == 0


def test_hot_buckets_are_tiled_and_keep_every_link(spark):
    rng = random.Random(1)
    prints = set()
    centre = rng.getrandbits(64)
    while len(prints) < 300:
        x = centre
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    links = {tuple(v & (2**64 - 1) for v in r) for r in simhash.near_links(df, 3, tile_rows=16).collect()}
    assert all((a ^ b).bit_count() <= 6 * 10 for a, b in links)

    def parts(pairs):
        root = {p: p for p in prints}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {p: find(p) for p in prints}

    exact = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    assert parts(links) == parts(exact)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
