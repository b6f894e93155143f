from lodestone.llm import decontaminate as dc

ITEM = "A farmer sells eggs at the market near Boston every week and packs 3 boxes into an old van before the rain comes"


def test_short_texts_are_looked_at_together(monkeypatch):
    own = dc.Templates([(1, ITEM)])
    calls = []
    hits = own._hits
    monkeypatch.setattr(own, "_hits", lambda *a: calls.append(1) or hits(*a))
    texts = ["", "Nothing here.", "Some lead. " + ITEM, ITEM.upper(), "--"] * 200
    found = [[m[0] for m in own.match(t)] for t in texts[:5]]
    calls.clear()
    assert [[m[0] for m in f] for f in own.matches(texts)] == found * 200 == [[], [], [1], [1], []] * 200
    assert len(calls) <= 2


def test_nothing_reaches_from_one_text_into_the_next(monkeypatch):
    half = ITEM.split()
    own = dc.Templates([(1, ITEM), (2, "the old road runs for 7 miles to the north gate of town"), (3, "hours later the train left for the coast again")])
    parts = [" ".join(half[:12]), " ".join(half[12:]), "the road is 7", "hours later the train left for the coast again", ITEM]
    for together in (1, 15, 1 << 15):
        monkeypatch.setattr(dc, "TOGETHER", together)
        assert [[m[0] for m in f] for f in own.matches(parts)] == [[], [], [], [3], [1]]
        assert list(own.matches([])) == [] and list(dc.Templates([]).matches(["a", ""])) == [[], []]
