import json
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import ingest
from lodestone.operators.transports import HashTransport
from lodestone.sources import collections as cs
from lodestone.sources import runs, store
from lodestone.streaming import ingest as stream

EMPTY = store.CHUNK_SCHEMA + ", ord long"


@pytest.fixture
def root(tmp_path):
    own = tmp_path / "docs" / "c"
    own.mkdir(parents=True)
    (own / "H.7.1.md").write_text("# Goods\n\nRules for goods.\n\n" + "More text here. " * 100)
    (own / "H.7.2.txt").write_text("Travel rules")
    (own / "broken.docx").write_bytes(b"no zip")
    (own / "skip.exe").write_bytes(b"")
    (tmp_path / "docs" / "manifest-all.json").write_text(json.dumps({"downloaded": [
        {"code": "7.2", "title": "Old", "file": "H.7.2.docx", "keywords": "a; b", "doctype": "Form", "version": 3}, {"title": "no code"}, {"code": "9", "title": "X"}]}))
    (own / "manifest.json").write_text(json.dumps({"documents": [{"code": "7.2", "title": "Travel", "keywords": ["k"], "url": "http://u"}]}))
    return tmp_path


def test_discovery_and_manifest(spark, root):
    docs = f"file://{root}/docs"
    found = store.list_documents(spark, docs, "c")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["H.7.1.md", "H.7.2.txt", "broken.docx"]
    assert store.list_documents(spark, docs, "none").count() == 0
    rows = {r["code"]: r for r in store.load_manifest(spark, docs, "c", "http://base/").collect()}
    assert rows["7.2"]["title"] == "Travel" and rows["7.2"]["keywords"] == ["k"] and rows["7.2"]["source_url"] == "http://u"
    assert store.load_manifest(spark, f"file://{root}/nowhere", "c").count() == 0
    shared = {r["code"]: r for r in store.load_manifest(spark, docs, "other", "http://base/").collect()}
    assert shared["7.2"]["keywords"] == ["a", "b"] and shared["7.2"]["source_url"] == "http://base/H.7.2" and shared["9"]["source_url"] == "http://base/H.9"


def test_manifests_that_are_none(spark, root):
    own = root / "docs" / "odd"
    own.mkdir()
    docs = f"file://{root}/docs"
    for text in ("no json at all {", json.dumps({"other": [{"code": "1"}]}), json.dumps({"downloaded": [{"title": "x"}]})):
        (own / "manifest.json").write_text(text)
        with pytest.warns(UserWarning, match="manifest.json"):
            assert {r["code"] for r in store.load_manifest(spark, docs, "odd").collect()} == {"7.2", "9"}
    (own / "manifest.json").write_text(json.dumps({"downloaded": None, "documents": [{"code": "5", "file": "a.b/X.5.1.PDF"}, {"code": "6", "file": "Y.6.txt"}]}))
    rows = {r["code"]: r["source_url"] for r in store.load_manifest(spark, docs, "odd", "http://b/").collect()}
    assert rows["5"] == "http://b/a.b/X.5.1" and rows["6"] == "http://b/Y.6.txt"


def test_each_new_chunk_is_embedded_once(spark, root, tmp_path):
    docs = f"file://{root}/docs"
    seen = tmp_path / "calls"
    seen.mkdir()

    class Counting(HashTransport):
        def embed(self, texts, purpose):
            for _ in texts:
                (seen / uuid.uuid4().hex).touch()
            return super().embed(texts, purpose)

    files, manifest = store.list_documents(spark, docs, "c"), store.load_manifest(spark, docs, "c")
    index, total, _ = ingest.ingest(files, manifest, spark.createDataFrame([], EMPTY), "c", "instruction", lambda: Counting(8))
    n = total.first()["chunks"]
    assert index.count() == n and len(index.collect()) == n and sorted(r["ord"] for r in index.collect()) == list(range(n))
    assert len(list(seen.iterdir())) == n


def test_runs(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    with runs.run_lock(spark, folder):
        with pytest.raises(runs.Locked):
            with runs.run_lock(spark, folder):
                pass
    with runs.run_lock(spark, folder):
        pass
    todo, done = spark.createDataFrame([(i,) for i in range(5)], "id int"), spark.createDataFrame([(1,)], "id int")
    assert [r["id"] for r in runs.plan(todo, done, 2).collect()] == [0, 2] and runs.plan(todo, None).count() == 5
    assert tuple(runs.summary(todo, done, 2).first()) == (5, 1, 2, 2)


def test_ingest_reuses_and_upserts(spark, root):
    docs = f"file://{root}/docs"
    files, manifest = store.list_documents(spark, docs, "c"), store.load_manifest(spark, docs, "c")
    run = lambda old, **k: ingest.ingest(files, manifest, old, "c", "instruction", lambda: HashTransport(8), **k)
    index, total, failures = run(spark.createDataFrame([], EMPTY))
    first = total.first()
    assert first["documents"] == 2 and first["embedded"] == first["chunks"] and first["reused"] == 0 and first["tokens"] > 0
    assert [r["key"].rsplit("/", 1)[1] for r in failures.collect()] == ["broken.docx"]
    index = index.cache()
    rows = {r["id"]: r for r in index.collect()}
    assert rows["7.1#0"]["title"] == "Goods" and rows["7.2#0"]["title"] == "Travel" and len(rows["7.1#0"]["embedding"]) == 8
    again, total, _ = run(index.withColumn("text", F.when(F.col("id") == "7.2#0", "changed").otherwise(F.col("text"))))
    assert total.first()["embedded"] == 1 and total.first()["reused"] == first["chunks"] - 1
    assert {r["id"]: r["ord"] for r in again.collect()} == {k: v["ord"] for k, v in rows.items()}
    assert run(index, reuse=False)[1].first()["reused"] == 0
    with pytest.raises(ValueError):
        ingest.ingest(files.filter("path like '%broken%'"), manifest, index, "c", "instruction", lambda: HashTransport(8))


def test_upsert_keeps_order_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "id string, v int, ord long")
    new = spark.createDataFrame([("b", 9, 0), ("c", 3, 1), ("c", 4, 2)], "id string, v int, ord long")
    once = store.upsert(old, new, ["id"])
    assert [(r["id"], r["v"]) for r in once.orderBy("ord").collect()] == [("a", 1), ("b", 9), ("c", 4)]
    twice = store.upsert(once, new, ["id"])
    assert [(r["id"], r["v"]) for r in twice.orderBy("ord").collect()] == [("a", 1), ("b", 9), ("c", 4)]


def test_index_files(spark, tmp_path):
    path, meta = f"file://{tmp_path}/index", f"file://{tmp_path}/meta"
    with pytest.raises(FileNotFoundError):
        store.load_index(spark, path)
    row = lambda c, i: (f"{c}#{i}", c, c, c, i, "t", None, None, None, None, [1.0, 2.0])
    info = spark.createDataFrame([("a", "m", "hash", "", 2, False, None)], store.META_SCHEMA)
    store.save_index(spark.createDataFrame([row("a", 0), row("b", 0)], store.CHUNK_SCHEMA), info, path, meta)
    store.save_index(spark.createDataFrame([row("a", 0), row("a", 1)], store.CHUNK_SCHEMA), info, path, meta)
    assert store.load_index(spark, path, "a").count() == 2 and store.load_index(spark, path, "b").count() == 1
    assert store.index_exists(spark, path, "a") and not store.index_exists(spark, path, "z")
    stamped = spark.read.parquet(meta)
    assert stamped.first()["indexed_at"] is not None
    assert store.reusable(store.load_index(spark, path), stamped, "hash", False).count() == 2 and store.reusable(store.load_index(spark, path), stamped, "other", False).count() == 0
    assert store.fully_embedded(store.load_index(spark, path, "a"), 2).first()["fully_embedded"]
    with pytest.raises(FileNotFoundError):
        store.load_index(spark, path, "z")


def test_vector_files(spark, tmp_path):
    data = store.pack_vectors([[1.0, 2.0], [3.0, 4.5]], 2)
    (tmp_path / "v.vec").write_bytes(data)
    rows = store.read_vectors(spark, f"file://{tmp_path}/v.vec", 2, 2).orderBy("ord").collect()
    assert [r["embedding"] for r in rows] == [[1.0, 2.0], [3.0, 4.5]]
    with pytest.raises(ValueError):
        store.read_vectors(spark, f"file://{tmp_path}/v.vec", 2, 3)
    with pytest.raises(ValueError):
        store.pack_vectors([[1.0]], 2)
    assert store.choose_format(2000, True) == "binary" and store.choose_format(5, True) == "json" and store.choose_format(5, True, "binary") == "binary"
    assert store.choose_format(9000, False, "binary") == "json"
    (tmp_path / "ctx.json").write_text('{"a#0": "said"}')
    assert [tuple(r) for r in store.load_contexts(spark, f"file://{tmp_path}/ctx.json").collect()] == [("a#0", "said")]
    assert store.load_contexts(spark, f"file://{tmp_path}/none.json").count() == 0


def test_collections(spark):
    registry = cs.Registry([cs.Collection("a"), cs.Collection("all", members=("a", "b", "c"))])
    assert registry.get("nowhere").id == "a"
    metas = spark.createDataFrame([("a", "2026-02-01"), ("b", "2026-01-01")], "collection string, indexed_at string")
    table = registry.table(spark)
    rows = {r["id"]: r for r in cs.coverage(table, metas).collect()}
    assert (rows["all"]["searched"], rows["all"]["declared"], rows["all"]["missing"]) == (2, 3, ["c"]) and rows["a"]["searched"] == 1
    assert cs.oldest_index(metas, cs.present_members(table, metas)).first()["indexed_at"] == "2026-01-01"
    key = spark.createDataFrame([("docs/x/a%20b+c.md",), ("up/H.7.1.docx",), ("docs/only",)], "k string").select(cs.collection_of(cs.decode_key(F.col("k")), ["7"]).alias("c"), cs.decode_key(F.col("k")).alias("k"))
    assert [tuple(r) for r in key.collect()] == [("x", "docs/x/a b c.md"), ("chapter-7", "up/H.7.1.docx"), ("default", "docs/only")]


def test_stream(spark, root):
    index, folder = f"file://{root}/live", f"file://{root}/docs/c"
    manifest = store.load_manifest(spark, f"file://{root}/docs", "c")
    run = lambda: stream.start(spark, folder, index, f"file://{root}/cp", "c", "instruction", manifest, lambda: HashTransport(8)).awaitTermination()
    run()
    before = stream.current(spark, index).count()
    assert before > 1 and spark.read.parquet(f"{index}/failures").count() == 1
    (root / "docs" / "c" / "H.7.3.txt").write_text("New rules")
    run()
    assert stream.current(spark, index).count() == before + 1
    assert spark.read.parquet(f"{index}/v=1").count() == 1  # a batch writes its own chunks only
    (root / "docs" / "c" / "H.7.3b.txt").write_text("Newer rules")
    stream.start(spark, folder, index, f"file://{root}/cp", "c", "instruction", manifest, lambda: HashTransport(8), merge_every=2).awaitTermination()
    assert [name for _, name in stream.folders(spark, index)] == ["merged=1", "v=2"]
    rows = stream.current(spark, index).collect()
    assert len(rows) == before + 2 and sorted(r["ord"] for r in rows) == list(range(before + 2))


def test_command_line(spark, root, capsys):
    index = f"file://{root}/cli"
    common = ["--index", index, "--collection", "c"]
    cli.main(["ingest", *common, "--docs", f"file://{root}/docs"])
    report = json.loads(capsys.readouterr().out)
    assert report["documents"] == 2 and report["reused"] == 0 and len(report["failures"]) == 1
    cli.main(["ingest", *common, "--docs", f"file://{root}/docs"])
    assert json.loads(capsys.readouterr().out)["embedded"] == 0
    cli.main(["retrieve", *common, "--k", "3", "travel rules 7.2"])
    assert json.loads(capsys.readouterr().out)[0]["code"] == "7.2"
