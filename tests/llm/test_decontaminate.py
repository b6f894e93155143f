import random

import pyarrow.parquet as pq

from lodestone.llm import decontaminate as dc

SF = "/root/testdata/sf0.1"


def test_passages_of_the_benchmark_are_all_caught_and_nothing_else():
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    own = dc.Templates([(r["item_id"], r["text"]) for r in bench])
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    plain = lambda t: " ".join(t.lower().split())  # noqa: E731  a passage in capitals is a leak like any other
    items = {b["item_id"]: plain(b["text"]) for b in bench}
    literal = {(r["doc_id"], i) for r in docs for t in [plain(r["text"])] for i, b in items.items() if b in t}
    found = {(r["doc_id"], m[0]) for r in docs for m in own.match(r["text"])}
    assert literal <= found
    assert {d for d, _ in found} == {d for d, _ in literal}


def canonical(text):
    """(template word, value) of lower-case words, numbers and the units behind them."""
    out = []
    for w in text.split():
        kind = "#num" if w.isdigit() else "#unit" if out and out[-1][0] == "#num" and w in dc.UNITS else w
        out.append((kind, w))
    return out


def brute(items, text, share=0.8):
    doc, found = canonical(text), []
    for item_id, body in items:
        own = canonical(body)
        size = min(5, len(own))
        template = lambda x, i: tuple(k for k, _ in x[i : i + size])  # noqa: B023, E731
        counted = [q for q in range(len(own) - size + 1) if sum(k[0] != "#" for k in template(own, q)) >= 3]
        hits = [(p, q) for p in range(len(doc) - size + 1) for q in counted if template(doc, p) == template(own, q)]

        def consistent(pairs):
            seen = {}
            for p, q in pairs:
                for j in range(size):
                    if own[q + j][0][0] == "#":
                        seen.setdefault(own[q + j], []).append(doc[p + j][1])
            usual = {s: max(set(v), key=lambda x: (v.count(x), x)) for s, v in seen.items()}
            good = lambda p, q: all(own[q + j][0][0] != "#" or usual[own[q + j]] == doc[p + j][1] for j in range(size))
            return len({q for p, q in pairs if good(p, q)})

        groups = [hits] + [[x for x in hits if a <= x[0] - x[1] <= a + len(own) // 2] for a in {p - q for p, q in hits}]
        best = max(map(consistent, groups)) if hits else 0
        if counted and best >= share * len(counted):
            found.append((item_id, len(counted), best))
    return sorted(found)


def test_against_brute_force():
    rng = random.Random(12)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    leaks = 0
    for _ in range(150):
        items = []
        for i in range(4):
            body = [rng.choice(words) if rng.random() < 0.75 else f"{rng.randint(1, 40)} {rng.choice(['km', 'hours', 'wa'])}" for _ in range(rng.randint(3, 14))]
            items.append((i, " ".join(body)))
        parts = [" ".join(rng.choices([*words, "xx", "7"], k=rng.randint(0, 12)))]
        for _ in range(rng.randint(1, 3)):
            said = rng.choice(items)[1].split()
            changed = {w: str(rng.randint(1, 99)) for w in set(said) if w.isdigit()} if rng.random() < 0.6 else {}
            said = [changed.get(w, w) for w in said]
            for _ in range(rng.choice([0, 0, 1, 2])):
                said[rng.randrange(len(said))] = rng.choice([*words, "yy", "3"])
            parts += [" ".join(said), " ".join(rng.choices(words, k=rng.randint(0, 6)))]
        text = " ".join(parts)
        got = sorted((i, need, good) for i, need, good, _ in dc.Templates(items).match(text))
        assert got == brute(items, text), (items, text)
        leaks += len(got)
    assert leaks > 100


def test_changed_values_are_caught_if_they_agree():
    item = "A train leaves the old station near Boston at 40 mph and after 3 hours the train from Boston turns back with 40 people on board of it"
    own = dc.Templates([(7, item)])
    other = item.replace("Boston", "Denver").replace("40", "65").replace("hours", "days")
    assert [m[0] for m in own.match("Intro text here.\n" + other + " more")] == [7]
    torn = item.replace("Boston", "Denver", 1).replace("40", "65", 1).replace("3 hours", "9 hours")
    assert own.match(torn)[0:1] == [] or own.match(torn)[0][2] < len(own.items[0].counted)
    assert own.match("A bus leaves the new depot near Boston at 40 mph and after 3 hours it stops") == []


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "the of"), (None, "x y z w v u")], "item_id long, text string")
    rows = [(1, "zero one two three four five six seven eight nine", 1), (1, "zero one two three four five six seven eight nine", 1), (2, None, 2), (3, "", 3), (4, "the of", 4),
            (None, "one two, THREE four... " * 3 + "w " * 50000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = [tuple(r) for r in dc.leaks(docs, bench).collect()]
    assert got == [(1, 1, 4, 4, 1.0)] * 2
    assert {r["doc_id"] for r in dc.keep_clean(docs, bench).collect()} == {2, 3, 4, None}
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.keep_clean(docs, bench.limit(0)).count() == 6
    assert dc.leaks(docs.limit(0), bench).count() == 0


def test_blocks_cover_the_benchmark(spark):
    bench = spark.createDataFrame([(i, "a b c d e f") for i in range(10)], "item_id long, text string")
    parts = list(dc.blocks(bench, 13))
    assert [len(p) for p in parts] == [2] * 5
