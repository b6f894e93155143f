import hashlib
import random

import pytest

from lodestone.llm import substring_dedup as sd


def brute(rows):
    datas = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, d in enumerate(datas):
        for p in range(len(d) - 199):
            seen.setdefault(d[p : p + 200], []).append((i, p))
    gone = [bytearray(len(d)) for d in datas]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + 200] = b"\x01" * 200
    out = []
    for (doc_id, _), d, g in zip(rows, datas, gone):
        kept = bytes(b for b, x in zip(d, g) if not x)
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        out.append((doc_id, len(d), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    passages = [prose(rng.choice([150, 190, 199, 200, 201, 260, 400, 700])) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 40)], prose(rng.choice([0, 1, 50, 250]))]
        texts.append("".join(parts))
    base = prose(1500)
    for _ in range(12):
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    texts += [texts[0], texts[3], "a" * 900, "ab" * 300, "a" * 205, "", None, "short", "same " * 60, passages[3] + passages[3], passages[5] * 3]
    return [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[4])]


@pytest.mark.parametrize(("seed", "bound", "least"), [(1, sd.GROUP_ROWS, sd.COMMON), (3, 2, 99), (4, 1, 99), (5, 40, 2), (6, 40, 3), (7, 3, 4)])
def test_against_brute_force(spark, seed, bound, least):
    """By suffix arrays alone, with anchors above the bound, and with anchors that the sample shows as common."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, mark string")
    out = sorted((tuple(r) for r in sd.without_repeats(docs, bound, least=least).collect()), key=str)
    assert out == brute(rows)


def test_maximal_repeats():
    rng = random.Random(0)
    mid = bytes(rng.choices(range(97, 123), k=260))
    rows = [b"L1" + mid + b"R1", b"L2" + mid + b"S2", b"zz" + mid + b"R1"]
    at = 100
    lefts, rights = [r[:at][::-1] for r in rows], [r[at:] for r in rows]
    found = {(left + right, tuple(sorted(own))) for left, right, own in sd.maximal_repeats(lefts, rights)}
    assert found == {(260, (0, 1, 2)), (262, (0, 2))}


def test_intervals():
    s = sorted([b"aab", b"aac", b"ab", b"b"])
    assert sorted(sd.prefix_intervals(s)) == [(0, 0, 3), (1, 0, 2), (2, 0, 1)]


def test_slices_name_the_same_anchors(monkeypatch):
    data = bytes(random.Random(8).choices(b"abc ", k=5000))
    whole = sd._places([(0, data), (1, data[:900])])
    monkeypatch.setattr(sd, "SLICE", 333)
    parts = sd._places([(0, data), (1, data[:900])])
    tell = lambda x: sorted(zip(*(c.tolist() for c in x)))
    assert tell(whole) == tell(parts)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.without_repeats(docs).count() == 0
