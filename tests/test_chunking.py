import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.config import Settings
from lodestone.functions import chunking as c

TINY = Settings(chunk_chars=60, chunk_overlap=15, min_block_chars=12)


def test_clauses_stand_alone_and_stubs_merge():
    text = "Intro line.\n\n1. First clause is here\n1.1 detail\n2. Second clause follows now\n3. x"
    assert c.chunk_text(text, TINY) == ["Intro line.", "1. First clause is here\n1.1 detail", "2. Second clause follows now", "3. x"]
    assert c.clauses("1. a\n2. second clause text", TINY) == ["1. a\n2. second clause text"]


def test_long_paragraphs_overlap():
    parts = [f"part {i} has some words in it" for i in range(8)]
    got = c.chunk_text("\n\n".join(parts), TINY)
    assert got[0] == "part 0 has some words in it part 1 has some words in it" and all(len(x) <= 60 for x in got)
    assert all(b.startswith("words in it part") for b in got[1:])


def test_hard_split_and_tail():
    assert list(c.hard_split("a" * 130, 60)) == ["a" * 60, "a" * 60, "a" * 10]
    assert list(c.hard_split("b" * 40 + " " + "c" * 40, 60)) == ["b" * 40, "c" * 40]
    assert c.tail("one two three", 7) == "three" and c.tail("short", 9) == "short" and c.tail("x" * 9, 4) == "" and c.tail("abc", 0) == ""


def test_tables_are_cut_by_line():
    table = "\n".join(f"{i}\tcell value {i}" for i in range(12))
    got = c.pack(table, 60)
    assert "\n".join(got) == table and all(len(x) <= 60 for x in got)


def test_nothing():
    assert c.chunk_text(None) == c.chunk_text("") == c.chunk_text(" \n\n ") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1. \n\tש;", max_size=400))
def test_no_chunk_is_longer_and_no_word_is_lost(text):
    got = c.chunk_text(text, TINY)
    assert all(0 < len(x) <= 60 for x in got)
    assert set("".join(text.split())) == set("".join("".join(got).split()))


def test_build(spark):
    docs = spark.createDataFrame([("c", "7.1", "T", "para one\n\npara two", ["k"]), ("c", "7.2", "T", None, None)], "collection string, code string, title string, text string, keywords array<string>")
    rows = c.build_chunks(docs, TINY).collect()
    assert [(r["id"], r["index"], r["text"], r["keywords"]) for r in rows] == [("7.1#0", 0, "para one para two", ["k"])]


def test_chunks_are_given_in_batches_of_bounded_size(spark, monkeypatch):
    """A worker holds about BATCH_CHARS of chunks, however many rows it is sent at once."""
    docs = spark.createDataFrame([("7.1", "x")], "code string, text string")
    bodies, given_to = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, body, schema: (bodies.append(body), given_to(self, body, schema))[1])
    c.build_chunks(docs, TINY)
    text = "some words of a text. " * 500
    batch = pa.RecordBatch.from_pydict({"code": [str(i) for i in range(400)], "text": [text] * 400})
    sizes = [sum(map(len, b.column(2).to_pylist())) for b in bodies[0](iter([batch]))]
    assert len(sizes) > 2 and max(sizes) <= c.BATCH_CHARS + 2 * len(text)
