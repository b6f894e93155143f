import pyarrow.parquet as pq

from lodestone.llm import decontaminate as dc

SF = "/root/testdata/sf0.1"
ITEM = "A farmer sells eggs at the market near Boston every week and packs 3 boxes into an old van before the rain comes"


def test_letter_case_loses_nothing():
    own = dc.Templates([(1, ITEM), (2, "Anna paints a red door while Peter mends the long fence behind their quiet house in April")])
    for text in (ITEM.upper(), ITEM.lower(), ITEM.title(), ITEM.replace("Boston", "Denver").upper(), ITEM.replace("Boston", "Peter").title()):
        assert [m[0] for m in own.match("Some lead. " + text + " and more")] == [1], text
    assert own.match("A FARMER SELLS EGGS NEAR THE OLD VAN AND A RED DOOR WHILE THE RAIN COMES EVERY WEEK") == []
    assert [m[0] for m in dc.Templates([(3, ITEM.upper())]).match(ITEM)] == [3]


def test_passages_in_any_case_are_all_caught_and_nothing_else():
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    own = dc.Templates([(r["item_id"], r["text"]) for r in bench])
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    low = [(b["item_id"], b["text"].lower()) for b in bench]
    held = {(r["doc_id"], i) for r in docs for t in [r["text"].lower()] for i, b in low if b in t}
    found = {(r["doc_id"], m[0]) for r in docs for m in own.match(r["text"])}
    assert held <= found and {(1699, 130), (6420, 37), (8376, 101)} <= found
    assert {d for d, _ in found} == {d for d, _ in held} | {1699, 6420, 8376}


def test_names_at_sentence_starts():
    item = "Tom buys three red pens today. Tom gives two of them away. Tom keeps the last one at home. Tom then walks to school."
    own = dc.Templates([(4, item)])
    assert [m[0] for m in own.match(item.replace("Tom", "Sara"))] == [4]
    assert [m[0] for m in own.match(item.replace("Tom", "Home"))] == [4]
    item = item.replace("two of them", "Tom's two of Tom Hill")
    assert [m[0] for m in dc.Templates([(5, item)]).match(item.replace("Tom", "Sara"))] == [5]


def test_each_copy_has_its_own_values():
    item = "The shop sold 12 pens for 30 coins on 4 days while the mill made 7 sacks from 90 kilos in 5 hours of hard work by 8 men"
    own = dc.Templates([(6, item)])
    filled = [item.replace("12", str(i)).replace("30", str(100 - i)).replace(" 4 ", f" {i * 7} ").replace("7 sacks", f"{50 - i} sacks").replace("90", str(i * 3)) for i in range(20, 40)]
    assert [m[0] for m in own.match("\n".join(filled))] == [6]
    assert own.match("\n".join(filled))[0][3] == 1.0
    assert [m[0] for m in own.match(" ".join(filled[:2]))] == [6]
