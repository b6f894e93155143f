"""Registered queries of the retrieval and evaluation operators, each with its DuckDB oracle.

Inputs that the tables don't hold (Hebrew, tabs, dotted codes, quotations) are
built from other columns, in the query and in the oracle alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions import extract, markdown, text
from lodestone.functions.chunking import build_chunks
from lodestone.operators import answer, clarify, evaluate, feedback, ingest, lexical, query_prep, rerank, retrieve
from lodestone.operators.containment import containing
from lodestone.operators.dense import dense_topk
from lodestone.sources import collections as sources
from lodestone.sources import store
from lodestone.sources.spread import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose long texts are worked on: over all cores, however few its files."""
    return spread(T(spark, sf, name))


# Dense search ----------------------------------------------------------------------

_EVERY = 50
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_PAIRS = f"""p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_COS} AS s
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % {_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS pos FROM p)"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = T(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("ord"), "embedding", "label")
    return vectors, e.filter(F.col("vec_id") % _EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _ranked(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The best k of each query without itself: (query_id, ord, label, score, pos)."""
    vectors, queries = _vectors(spark, sf)
    near = dense_topk(vectors, queries, k + 1).filter("ord <> query_id")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("pos", pos).filter(F.col("pos") <= k).join(vectors.select("ord", "label"), "ord").drop("rank")


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, round(s, 6) AS score, pos FROM r WHERE pos <= 12")
def dense_topk_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, 12).select("query_id", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), "pos")


@query(
    f"""WITH q AS (SELECT vec_id - vec_id % {_EVERY} AS query_id, embedding FROM embeddings WHERE vec_id % {_EVERY} < 3),
    b AS (SELECT query_id, vec_id, greatest(-1, max({_COS})) AS s FROM q, embeddings v GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS pos FROM b)
    SELECT query_id, vec_id, round(s, 6) AS score, pos FROM r WHERE pos <= 10"""
)
def dense_best_of_variants(spark: SparkSession, sf: str) -> DataFrame:
    e = T(spark, sf, "embeddings")
    queries = e.filter(F.col("vec_id") % _EVERY < 3).select((F.col("vec_id") - F.col("vec_id") % _EVERY).alias("query_id"), F.col("embedding").alias("vector"))
    near = dense_topk(e.select(F.col("vec_id").alias("ord"), "embedding"), queries, 10)
    return near.select("query_id", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").alias("pos"))


@query(
    f"""WITH {_PAIRS}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY pos) AS n FROM r WHERE pos <= 40),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, pos) AS k FROM c)
    SELECT query_id, vec_id, label, round(s, 6) AS score FROM d WHERE k <= 12"""
)
def dense_capped_topk(spark: SparkSession, sf: str) -> DataFrame:
    picked = retrieve.diversify(_ranked(spark, sf, 40), 12, DEFAULT.max_per_doc, ["label"], [F.col("pos")])
    return picked.select("query_id", F.col("ord").alias("vec_id"), "label", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_PAIRS} SELECT query_id, round(max(s), 6) AS best, max(s) >= 0.30 AS confident_030, max(s) >= 0.36 AS confident_036
    FROM r WHERE pos <= 12 GROUP BY query_id"""
)
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    hits = _ranked(spark, sf, 12).withColumn("lexical", F.lit(False)).withColumn("named", F.lit(False))
    low, high = (retrieve.confident(hits, F.lit(t)) for t in (0.30, 0.36))
    return low.select("query_id", F.round("best", 6).alias("best"), F.col("confident").alias("confident_030")).join(
        high.select("query_id", F.col("confident").alias("confident_036")), "query_id"
    )


@query(
    f"""WITH {_PAIRS}, h AS (SELECT * FROM r WHERE pos <= 12), t AS (SELECT label, count(*) AS total FROM embeddings GROUP BY label),
    g AS (SELECT h.*, total, count(*) OVER w AS votes, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, pos) AS b,
      sum(1.0 / (3 + pos)) OVER w AS joint_all, min(pos) OVER w AS first_pos FROM h JOIN t USING (label) WINDOW w AS (PARTITION BY query_id, label)),
    o AS (SELECT *, votes >= 2 AND total >= 2 AND votes / total >= 0.05 AS ok FROM g),
    a AS (SELECT *, max(ok::INT) OVER (PARTITION BY query_id) AS applied, CASE WHEN ok THEN joint_all ELSE 1.0 / (3 + pos) END AS joint,
      CASE WHEN ok THEN first_pos ELSE pos END AS first_at FROM o WHERE NOT ok OR b = 1)
    SELECT query_id, vec_id, CASE WHEN applied = 1 THEN row_number() OVER (PARTITION BY query_id ORDER BY round(joint, 12) DESC, first_at) ELSE pos END AS pos,
      CASE WHEN ok THEN votes END AS parent_votes, applied = 1 AS applied FROM a"""
)
def parent_vote(spark: SparkSession, sf: str) -> DataFrame:
    hits = _ranked(spark, sf, 12).select(
        "query_id", "pos", F.lit("c").alias("collection"), F.col("label").cast("string").alias("code"), F.col("ord").cast("string").alias("id"),
        "score", F.lit(False).alias("lexical"), F.lit(False).alias("named"),
    )
    chunks = T(spark, sf, "embeddings").select(F.lit("c").alias("collection"), F.col("label").cast("string").alias("code"))
    voted = retrieve.parent_vote(hits, retrieve.chunks_per_doc(chunks), Settings(parent_vote=True, parent_vote_ratio=0.05))
    return voted.select("query_id", F.col("id").cast("long").alias("vec_id"), F.col("pos").cast("long").alias("pos"), "parent_votes", "applied")


@query(
    f"""WITH q AS (SELECT vec_id, list_reverse(embedding) AS embedding FROM embeddings WHERE vec_id % {_EVERY} = 0),
    p AS (SELECT q.vec_id AS query_id, v.label, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS n FROM q, embeddings v)
    SELECT query_id, s >= 0.35 AS matched, CASE WHEN s >= 0.35 THEN label::VARCHAR ELSE '' END AS codes, round(s, 6) AS similarity FROM p WHERE n = 1"""
)
def feedback_nearest(spark: SparkSession, sf: str) -> DataFrame:
    e = T(spark, sf, "embeddings").withColumn("collection", F.lit("c"))
    told = e.select(F.col("vec_id").alias("ord"), "collection", F.col("embedding").alias("vector"), F.array(F.col("label").cast("string")).alias("codes"))
    asked = e.filter(F.col("vec_id") % _EVERY == 0).select(F.col("vec_id").alias("query_id"), "collection", F.reverse("embedding").alias("vector"))
    found = feedback.recall(asked, told, Settings(feedback_similarity=0.35))
    return found.select("query_id", "matched", F.array_join("codes", ",").alias("codes"), F.round("similarity", 6).alias("similarity"))


@query("SELECT label::VARCHAR AS collection, label % 3 <> 0 AS fully_embedded FROM embeddings GROUP BY label")
def vector_space_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Every third label holds vectors that are too short, missing, or both."""
    odd = F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 63))
    e = T(spark, sf, "embeddings").select(F.col("label").cast("string").alias("collection"), F.when(F.col("label") % 3 != 0, F.col("embedding")).otherwise(odd).alias("embedding"))
    return store.fully_embedded(e, 64)


# Lexical search -----------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


_HEBREW = ["והספקים", "לכשהמכרז", "הוראת", "של", "מע\"מ", "שלום", "ומהחוזה", "ב", "כתובתם", "ולכן", "ה7.6", "בַּמִּכְרָז"]
_LOOSE = "\u0591-\u05c7"  # points
_PEEL = "'^(?:" + "|".join(text.PARTICLES) + ")([\\s\\S]{3,})$'"


def _with_hebrew(d: DataFrame, key: str) -> DataFrame:
    """Texts with two Hebrew words behind them, chosen by the key."""
    words = F.array(*map(F.lit, _HEBREW))
    pick = lambda k: F.element_at(words, (F.pmod(F.col(key) * k, F.lit(len(_HEBREW))) + 1).cast("int"))
    return d.withColumn("text", F.concat_ws(" ", "text", pick(1), pick(5)))


def _hebrew_sql(source: str, key: str) -> str:
    words = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _HEBREW) + "]"
    pick = lambda k: f"{words}[{key} * {k} % {len(_HEBREW)} + 1]"
    return f"x AS (SELECT {key}, concat_ws(' ', text, {pick(1)}, {pick(5)}) AS text FROM {source})"


def _tokens_sql(source: str, key: str, words: str, name: str = "k", place: str = "") -> str:
    """Tokens (key, term) as table ``name``: numbers and codes as they are, other words folded, with what is left behind one and two particles."""
    raw = f"regexp_extract_all({words}, '[\\x{{0590}}-\\x{{05FF}}A-Za-z0-9_.]+')"
    at = f", generate_subscripts({raw}, 1) AS i" if place else ""
    i = ", i" if place else ""
    fold = f"translate(lower(regexp_replace(regexp_replace(raw, '^\\.+|\\.+$', '', 'g'), '[{_LOOSE}\"''״׳]', '', 'g')), '{text.FINAL_LETTERS}', '{text.PLAIN_LETTERS}')"
    number = "regexp_full_match(raw, '[0-9][0-9.]*')"
    return f"""{name}w AS (SELECT {key}, unnest({raw}) AS raw{at} FROM {source}),
    {name}n AS (SELECT {key}, raw{i}, {number} AS num, CASE WHEN {number} THEN regexp_replace(raw, '\\.$', '') ELSE {fold} END AS term FROM {name}w),
    {name}o AS (SELECT *, CASE WHEN num THEN term ELSE regexp_replace(term, {_PEEL}, '\\1') END AS once FROM {name}n WHERE num OR (length(term) >= 2 AND term NOT IN ({_STOP}))),
    {name}v AS (SELECT {key}{i}, num, unnest(list_distinct([term, once, CASE WHEN num THEN term ELSE regexp_replace(once, {_PEEL}, '\\1') END])) AS term FROM {name}o),
    {name} AS (SELECT {key}, term{i} FROM {name}v WHERE num OR length(term) >= 2)"""


@query(
    f"""WITH {_hebrew_sql("documents", "doc_id")}, {_tokens_sql("x", "doc_id", "text")}, l AS (SELECT doc_id, count(*) AS length FROM k GROUP BY doc_id)
    SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM k JOIN l USING (doc_id) GROUP BY doc_id, term"""
)
def token_postings(spark: SparkSession, sf: str) -> DataFrame:
    p = lexical.postings(_with_hebrew(T(spark, sf, "documents"), "doc_id"), F.col("text"), ["doc_id"])
    return p.select("doc_id", "term", "tf", F.col("length").cast("long").alias("length"))


def _bm25_sql(by: str = "") -> str:
    """Ranking of the documents for each benchmark item, by the corpus columns ``by``; both sides with Hebrew words."""
    own, same = f"{by}, " if by else "", f"USING ({by})" if by else ""
    return f"""WITH {_hebrew_sql("documents", "doc_id")}, y AS (SELECT item_id, concat_ws(' ', text, 'הספקים 7.6') AS text FROM benchmark),
    {_tokens_sql("x", "doc_id", "text")}, {_tokens_sql("y", "item_id", "text", "b", "i")},
    n AS (SELECT {own}doc_id, count(k.term) AS length FROM documents LEFT JOIN k USING (doc_id) GROUP BY {own}doc_id),
    s AS (SELECT {own}count(*) AS n, avg(length) AS al FROM n {"GROUP BY " + by if by else ""}),
    tf AS (SELECT {own}doc_id, term, count(*) AS tf FROM k JOIN documents USING (doc_id) GROUP BY ALL), df AS (SELECT {own}term, count(*) AS df FROM tf GROUP BY ALL),
    q AS (SELECT item_id AS query_id, term, min(i) AS i FROM b GROUP BY ALL),
    sc AS (SELECT query_id, {own}doc_id, min(i) AS i, sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (length / al)))) AS score
      FROM q JOIN tf USING (term) JOIN df USING ({own}term) JOIN n USING ({own}doc_id) {"JOIN s " + same if by else ", s"} GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id{", " + by if by else ""} ORDER BY round(score, 9) DESC, i, doc_id) AS rank FROM sc)"""


def _bm25(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    docs = _with_hebrew(T(spark, sf, "documents"), "doc_id").withColumnRenamed("doc_id", "ord")
    queries = T(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", F.lit("הספקים 7.6")).alias("text"))
    top = lexical.bm25(docs, F.col("text"), queries, 10, by=by)
    return top.select("query_id", *by, F.col("ord").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_bm25_sql() + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each benchmark item, in order."""
    return _bm25(spark, sf, [])


@query(_bm25_sql("source") + " SELECT query_id, source, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def bm25_by_collection(spark: SparkSession, sf: str) -> DataFrame:
    """The same within each source, weighed by that source's own statistics."""
    return _bm25(spark, sf, ["source"])


@query()
def bm25_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunking and word search together: the ten best chunks of every benchmark item."""
    d = texts(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("code"), F.col("source").alias("title"), "text")
    made = build_chunks(d).withColumn("keywords", F.array().cast("array<string>"))
    rows = made.withColumn("ord", F.col("code").cast("long") * 100_000 + F.col("index"))
    queries = T(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    top = lexical.bm25(rows, lexical.chunk_words(), queries, 10)
    return top.select("query_id", "ord", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH l AS (SELECT source, doc_id, 1 AS list, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents
      UNION ALL SELECT source, doc_id, 2, row_number() OVER (PARTITION BY source ORDER BY doc_id) FROM documents WHERE doc_id % 3 = 0),
    g AS (SELECT source, doc_id, sum(1.0::DOUBLE / (60 + pos)) AS s, min(list * 1000000 + pos) AS f FROM l WHERE pos <= 50 GROUP BY ALL)
    SELECT source, doc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY source ORDER BY s DESC, f) AS rank FROM g"""
)
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    d = T(spark, sf, "documents")
    place = lambda order: F.row_number().over(Window.partitionBy("source").orderBy(*order))
    a = d.select("source", "doc_id", F.lit(1).alias("list"), place([F.desc("n_chars"), F.col("doc_id")]).alias("pos"))
    b = d.filter("doc_id % 3 = 0").select("source", "doc_id", F.lit(2).alias("list"), place([F.col("doc_id")]).alias("pos"))
    fused = lexical.rrf(a.filter("pos <= 50").unionByName(b.filter("pos <= 50")), ["doc_id"], by="source")  # cut to 50 before the shuffle
    return fused.select("source", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one-chunk documents with a vector made of their statistics; every eleventh has none."""
    d = T(spark, sf, "documents")
    v = F.array(*[(F.length(F.translate("text", c, "")) / F.greatest(F.length("text"), F.lit(1)) - 0.9).cast("float") for c in "etaoinshrdlu"])
    return d.select(
        F.col("doc_id").alias("ord"), F.col("source").alias("collection"), F.concat(F.lit("7."), F.col("doc_id").cast("string"), F.lit(".1")).alias("code"),
        F.concat(F.lit("7."), F.col("doc_id").cast("string"), F.lit(".1#0")).alias("id"), F.col("source").alias("title"), F.lit(0).alias("index"), "text",
        F.array("lang").alias("keywords"), F.lit("Instruction").alias("doctype"), F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("doc_id") % 11 != 0, v).alias("embedding"),
    )


def _hybrid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunk_table(spark, sf)
    b = T(spark, sf, "benchmark")
    v = F.array(*[(F.length(F.translate("text", c, "")) / F.greatest(F.length("text"), F.lit(1)) - 0.9).cast("double") for c in "etaoinshrdlu"])
    named = F.concat(F.col("text"), F.lit(" see 7."), F.col("item_id").cast("string"), F.lit(".1"))
    return b.select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), named.alias("text"), v.alias("vector")), chunks


def _letters_sql(kind: str) -> str:
    return "[" + ", ".join(f"(length(replace(text, '{c}', '')) / greatest(length(text), 1) - 0.9)::{kind}" for c in "etaoinshrdlu") + "]"


def _hybrid_sql(pool: int, first: str, columns: str) -> str:
    """Dense, word and named lists fused by reciprocal ranks, and the best twelve in the order ``first``."""
    return f"""WITH d AS (SELECT doc_id, source, lang, text, '7.' || doc_id || '.1' AS code, CASE WHEN doc_id % 11 <> 0 THEN {_letters_sql("FLOAT")}::DOUBLE[] END AS v FROM documents),
    x AS (SELECT doc_id, concat_ws(' ', code, nullif(source, ''), nullif(lang, ''), nullif(text, '')) AS text FROM d),
    y AS (SELECT item_id, text || ' see 7.' || item_id || '.1' AS text, {_letters_sql("DOUBLE")} AS v FROM benchmark),
    {_tokens_sql("x", "doc_id", "text")}, {_tokens_sql("y", "item_id", "text", "b", "i")},
    n AS (SELECT doc_id, count(k.term) AS length FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(length) AS al FROM n),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    q AS (SELECT item_id AS query_id, term, min(i) AS i FROM b GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, min(i) AS i, sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (length / al)))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN n USING (doc_id), s GROUP BY ALL),
    lx AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, i, doc_id) AS lp FROM sc QUALIFY lp <= 10),
    dn AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(y.v, d.v), 12) DESC, doc_id) AS dp FROM y, d WHERE d.v IS NOT NULL QUALIFY dp <= {pool}),
    nm AS (SELECT item_id AS query_id, doc_id, 1 AS np FROM y JOIN d ON item_id = doc_id),
    u AS (SELECT query_id, doc_id, dp, lp, np FROM dn FULL JOIN lx USING (query_id, doc_id) FULL JOIN nm USING (query_id, doc_id)),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1.0::DOUBLE / (60 + dp), 0) + coalesce(1.0::DOUBLE / (60 + lp), 0) + coalesce(1.0::DOUBLE / (60 + np), 0) DESC,
      CASE WHEN dp IS NOT NULL THEN 1 WHEN lp IS NOT NULL THEN 2 ELSE 3 END, coalesce(dp, lp, np)) AS r FROM u QUALIFY r <= {pool}),
    h AS (SELECT f.*, d.code, d.source AS collection, coalesce(list_cosine_similarity(y.v, d.v), 0) AS score, d.v IS NULL AND np IS NULL AS lexical, np IS NOT NULL AS named,
      row_number() OVER (PARTITION BY query_id ORDER BY {first}) AS pos FROM f JOIN d USING (doc_id) JOIN y ON query_id = item_id)
    SELECT query_id, pos, {columns} FROM h WHERE pos <= 12"""


@query(_hybrid_sql(48, "r", "code, round(score, 6) AS score, lexical, named"))
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = _hybrid(spark, sf)
    found = retrieve.retrieve(queries, chunks, 12)
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "code", F.round("score", 6).alias("score"), "lexical", "named")


@query(_hybrid_sql(72, "NOT named, r", "collection, code, lexical, named"))
def hybrid_union_topk(spark: SparkSession, sf: str) -> DataFrame:
    queries, chunks = _hybrid(spark, sf)
    return retrieve.retrieve_union(queries, chunks, 12).select("query_id", F.col("pos").cast("long").alias("pos"), "collection", "code", "lexical", "named")


@query(
    f"""WITH {_PAIRS}, h AS (SELECT *, label % 3 AS c, CASE WHEN pos % 5 = 0 THEN true ELSE false END AS lex, pos = 7 AS named FROM r WHERE pos <= 20),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT named, round(s, 12) DESC, c, vec_id) AS a FROM h WHERE NOT lex),
    m AS (SELECT *, row_number() OVER (PARTITION BY query_id, c, label ORDER BY a) AS n FROM o),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, a) AS k FROM m QUALIFY k <= 8),
    e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, c, vec_id) AS b FROM h WHERE lex QUALIFY b <= 3)
    SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY l, x) AS pos FROM (SELECT query_id, vec_id, 0 AS l, a AS x FROM g UNION ALL SELECT query_id, vec_id, 1, b FROM e)"""
)
def merged_collections(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of three collections as one list, with named and word hits among them."""
    hits = _ranked(spark, sf, 20)
    shaped = hits.select(
        "query_id", "ord", "score", (F.col("pos") % 5 == 0).alias("lexical"), (F.col("pos") == 7).alias("named"), F.col("pos").alias("fused_rank"),
        (F.col("label") % 3).cast("string").alias("collection"), F.col("label").cast("string").alias("code"), F.col("ord").cast("string").alias("id"),
    )
    return retrieve.merge_collections(shaped, 8).select("query_id", F.col("ord").alias("vec_id"), F.col("pos").cast("long").alias("pos"))


@query("SELECT item_id AS query_id, '7.' || item_id || '.1' AS code FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)")
def named_codes(spark: SparkSession, sf: str) -> DataFrame:
    asked = T(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("what says 7."), F.col("item_id").cast("string"), F.lit(".1 and 9.9?")).alias("text"))
    return retrieve.named_codes(asked, _chunk_table(spark, sf))


_NAMED_PART = "p_name || ' nr' || p_partkey % 97"
_PART_TEXT = f"concat_ws(chr(9), p_partkey::VARCHAR, {_NAMED_PART}, p_brand, p_type, p_size::VARCHAR, 'end')"


def _named_part() -> Column:
    return F.concat(F.col("p_name"), F.lit(" nr"), (F.col("p_partkey") % 97).cast("string"))


def _part_chunks(spark: SparkSession, sf: str) -> DataFrame:
    p = texts(spark, sf, "part")
    cells = [F.col("p_partkey").cast("string"), _named_part(), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.lit("end")]
    return p.select(F.col("p_partkey").alias("ord"), F.lit("c").alias("collection"), F.col("p_brand").alias("code"), F.concat_ws("\t", *cells).alias("text"))


@query(
    f"""WITH w AS (SELECT p_size AS query_id, string_split({_NAMED_PART}, ' ') AS w FROM part),
    q AS (SELECT DISTINCT query_id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT query_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w) WHERE length(w[i]) >= 3 AND length(w[i + 1]) >= 3),
    c AS (SELECT p_brand AS code, {_PART_TEXT} AS text FROM part),
    r AS (SELECT phrase FROM (SELECT DISTINCT phrase FROM q) JOIN c ON contains(text, phrase) GROUP BY phrase HAVING count(DISTINCT code) <= 8)
    SELECT query_id, phrase FROM q JOIN r USING (phrase)"""
)
def rare_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Word pairs of the parts' names and numbers that at most eight brands' rows hold."""
    asked = texts(spark, sf, "part").select(F.col("p_size").alias("query_id"), F.concat(F.lit("מה "), _named_part(), F.lit("?")).alias("text"))
    return retrieve.rare_phrases(asked, _part_chunks(spark, sf))


@query("SELECT p_partkey, p_size % 2 = 0 AS tabular FROM part")
def tabular_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.concat_ws("\t", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.lit("x"), F.when(F.col("p_size") % 2 == 0, F.lit("y")))
    return T(spark, sf, "part").select("p_partkey", text.is_tabular(cells).alias("tabular"))


# Text ------------------------------------------------------------------------------------


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, ceil(length(text) / 4.0 + 4 / 2.5)::BIGINT AS tokens_hebrew FROM documents")
def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    hebrew = F.concat(F.col("text"), F.lit("שלום"))
    return T(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.estimate_tokens(hebrew).alias("tokens_hebrew"))


@query(
    r"""WITH b AS (SELECT doc_id, chr(8206) || replace(replace(text, chr(10), chr(13) || chr(10)), '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)) || chr(13) AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '\p{Cf}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM b"""
)
def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    built = F.concat(F.lit("‎"), F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\n\n\n\n")), F.lit("\r"))
    return texts(spark, sf, "documents").select("doc_id", F.md5(text.normalise_text(built)).alias("digest"))


@query()
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "pages").select("page_id", extract.structured_text(F.col("html")).alias("text"))


_PLAIN = "regexp_replace(text, '[^A-Za-z0-9 .,\\n]', '', 'g')"


@query(f"""WITH p AS (SELECT doc_id, lang, source, regexp_replace(regexp_replace({_PLAIN}, '\\n', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents)
    SELECT doc_id, md5('Head ' || doc_id || chr(10) || t || chr(10) || 'see ' || source || ' and ' || lang || chr(10) || chr(10) || t || ' ' || lang || chr(10)) AS digest FROM p WHERE t <> ''""")
def markdown_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's words within headings, quotes, links, cells, emphasis, code and comments."""
    t = F.trim(F.translate(F.regexp_replace("text", r"[^A-Za-z0-9 .,\n]", ""), "\n", " "))
    head = F.concat(F.lit("## Head "), F.col("doc_id").cast("string"), F.lit("\n- **"), t, F.lit("**\n> see [`"), F.col("source"), F.lit("`](http://x) and <b>"), F.col("lang"), F.lit("</b>\n"))
    md = F.concat(head, F.lit("```\n"), t, F.lit("\n```\n*"), t, F.lit("* | __"), F.col("lang"), F.lit("__\n![i](j)<!-- "), t, F.lit(" -->"))
    return T(spark, sf, "documents").filter(t != "").select("doc_id", F.md5(markdown.markdown_to_text(md)).alias("digest"))


@query(
    """WITH s AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(10), ' '), '(?:[^.!?;: ]|[.!?;:]+[^.!?;: ]| +)*[.!?;:]*')) AS p FROM documents)
    SELECT doc_id, count(*) AS sentences FROM s WHERE trim(p) <> '' GROUP BY doc_id"""
)
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents").select("doc_id", F.size(text.split_sentences(F.translate("text", "\n", " "))).cast("long").alias("sentences"))
    return d.filter("sentences > 0")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE 1 + (l_linenumber % 2 = 0)::INT + 2 * (l_orderkey % 3 = 0)::INT END AS depth FROM lineitem"""
)
def clause_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of one to four parts, with and without a dot behind them; every fifth line has none."""
    deep = F.when(F.col("l_linenumber") % 2 == 0, F.lit("3")), F.when(F.col("l_orderkey") % 3 == 0, F.lit("12.1"))
    number = F.concat_ws(".", F.col("l_linenumber").cast("string"), *deep)
    line = F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("clause "), number)).when(F.col("l_linenumber") % 4 == 0, F.concat(number, F.lit(" clause"))).otherwise(F.concat(number, F.lit(". clause")))
    return T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.clause_depth(line).alias("depth"))


@query()
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("code"), "text")
    return build_chunks(d).select("collection", "code", "id", "index", F.length("text").alias("length"), F.md5("text").alias("digest"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS word FROM documents)
    SELECT doc_id, count(DISTINCT word) AS words, 0::BIGINT AS too_long FROM w GROUP BY doc_id"""
)
def chunk_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """No chunk is longer than the limit, and the chunks hold a document's words, all of them and no others."""
    d = texts(spark, sf, "documents")
    made = build_chunks(d.select("doc_id", F.col("doc_id").cast("string").alias("code"), "text"))
    words = made.select("doc_id", F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("word"), (F.length("text") > DEFAULT.chunk_chars).alias("long"))
    return words.filter("word <> ''").groupBy("doc_id").agg(F.countDistinct("word").alias("words"), F.count_if("long").alias("too_long"))


_VIEW = "CASE WHEN doc_id % 3 = 0 THEN source || ' | ' || lang || ', x' || chr(10) || chr(10) || text WHEN doc_id % 3 = 1 THEN lang || ', x' || chr(10) || chr(10) || text ELSE text END"


def _viewed(d: DataFrame, body: str = "text") -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("doc_id").cast("string"))
    keywords = F.when(F.col("doc_id") % 3 != 2, F.array(F.col("lang"), F.lit("x")))
    view = text.embedding_view(F.col(body), title, F.col("doc_id").cast("string"), keywords)
    return d.withColumn("view", view)


@query(f"SELECT doc_id, md5({_VIEW}) AS digest FROM documents")
def embedding_view(spark: SparkSession, sf: str) -> DataFrame:
    return _viewed(T(spark, sf, "documents")).select("doc_id", F.md5("view").alias("digest"))


@query("SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS reused FROM documents")
def reuse_split(spark: SparkSession, sf: str) -> DataFrame:
    """New chunks against an older state: every fifth is missing, every fourth has other text, every seventh no vector."""
    d = T(spark, sf, "documents")
    shape = [F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("doc_id").cast("string").alias("code"), F.col("source").alias("title"), "text", F.array("lang").alias("keywords")]
    older = d.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    vector = F.when(F.col("doc_id") % 7 != 0, F.array(F.lit(1.0)))
    found = ingest.split_reusable(d.select(*shape), older.select(*shape, vector.alias("embedding")))
    return found.select("doc_id", F.col("embedding").isNotNull().alias("reused"))


@query(
    """WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY lpad(doc_id::VARCHAR, 12, '0')) - 1 AS ord FROM documents WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id, -n_chars AS n_chars, row_number() OVER (ORDER BY lpad(doc_id::VARCHAR, 12, '0')) - 1 AS ord FROM documents WHERE doc_id % 2 = 0), m AS (SELECT max(ord) + 1 AS m FROM o)
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.n_chars, o.n_chars) AS n_chars, coalesce(o.ord, n.ord + m) AS ord FROM o FULL JOIN n USING (doc_id), m"""
)
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows are numbered as ingest numbers them, by range partitions."""
    code = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    d = T(spark, sf, "documents").select("doc_id", "n_chars", code.alias("id"), code.alias("code"), F.lit(0).alias("index"))
    old = ingest.numbered(d.filter("doc_id % 3 <> 0")).select("doc_id", "n_chars", "ord")
    new = ingest.numbered(d.filter("doc_id % 2 = 0")).select("doc_id", (-F.col("n_chars")).alias("n_chars"), "ord")
    return store.upsert(old, new, ["doc_id"]).select("doc_id", "n_chars", "ord")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source END AS words FROM documents")
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("lang"), F.lit(" ;,\n"), F.col("source"), F.lit("; "))).otherwise(F.lit(" ;\n,"))
    return T(spark, sf, "documents").select("doc_id", F.when(text.normalise_keywords(raw).isNotNull(), F.array_join(text.normalise_keywords(raw), "|")).alias("words"))


@query(
    """WITH h AS (SELECT l_orderkey AS q, l_linenumber AS i FROM lineitem WHERE l_quantity >= 40)
    SELECT q AS query_id, l_linenumber AS index, max(CASE WHEN i = l_linenumber THEN 1.0 ELSE 0.0 END)::DOUBLE AS score,
    row_number() OVER (PARTITION BY q ORDER BY l_linenumber) AS pos
    FROM h JOIN lineitem ON l_orderkey = q AND l_linenumber BETWEEN i - 1 AND i + 1 GROUP BY q, l_linenumber"""
)
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = T(spark, sf, "lineitem").select(
        F.lit("c").alias("collection"), F.col("l_orderkey").cast("string").alias("code"), F.col("l_linenumber").alias("index"), F.lit("t").alias("text"),
        F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_quantity",
    )
    hits = rows.filter("l_quantity >= 40").drop("l_quantity").distinct().withColumn("query_id", F.col("code").cast("long"))
    rows = rows.drop("l_quantity").distinct()
    hits = hits.withColumn("score", F.lit(1.0)).withColumn("pos", F.col("index"))
    found = retrieve.neighbours(hits, rows, 1)
    return found.select("query_id", "index", "score", F.col("pos").cast("long").alias("pos"))


@query("WITH c AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, md5(string_agg(chr(10) || text, '' ORDER BY turn)) AS digest FROM c GROUP BY conv_id")
def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = T(spark, sf, "conversations").select(F.lit("c").alias("collection"), F.col("conv_id").alias("code"), F.col("turn").alias("index"), "text")
    return store.document_texts(c).select(F.col("code").alias("conv_id"), F.md5("body").alias("digest"))


@query()
def parent_context(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents").select(F.lit("c").alias("collection"), F.col("doc_id").cast("string").alias("code"), "text", F.col("source").alias("title"))
    made = build_chunks(d)
    hits = made.filter(F.col("index") == 2).withColumn("query_id", F.floor(F.col("code").cast("long") / 2))
    hits = hits.withColumn("score", F.lit(0.5)).withColumn("lexical", F.lit(False))
    hits = hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("code")))
    return retrieve.parent_context(hits.select(*hits.columns), made).select("query_id", "pos", "id", F.length("text").alias("length"), "score")


# Names and places ---------------------------------------------------------------------


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'chapter-7' WHEN 2 THEN 'default' ELSE 'default' END AS collection FROM part"""
)
def route_collection(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 4
    key = (
        F.when(kind == 0, F.concat(F.lit("docs/"), F.lower("p_type"), F.lit("/a+b.docx")))
        .when(kind == 1, F.lit("x/H.7.1.docx"))
        .when(kind == 2, F.lit("H.99.1.docx"))
        .otherwise(F.lit("plain.docx"))
    )
    return T(spark, sf, "part").select("p_partkey", sources.collection_of(sources.decode_key(key), ["7", "8"]).alias("collection"))


@query(
    """SELECT p_partkey, '7.' || p_partkey || '.1' AS code, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '7.' || p_partkey || '.1' END AS title,
    p_size % 3 <> 0 AS document FROM part"""
)
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.when(F.col("p_size") % 3 != 0, F.lit(".DOCX")).otherwise(F.lit(".exe"))
    path = F.concat(F.lit("a\\b/h.7."), F.col("p_partkey").cast("string"), F.lit(".1"), ext)
    code = text.derive_code(path, F.lit("instruction"))
    listed = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("  "), "p_name"))
    return T(spark, sf, "part").select("p_partkey", code.alias("code"), text.title_for(code, text.extension(path), F.lit(None).cast("string"), listed).alias("title"), text.is_document(path).alias("document"))


@query(
    """WITH m AS (SELECT unnest(['src1', 'src3', 'nowhere', 'src5']) AS member), p AS (SELECT DISTINCT source FROM documents)
    SELECT 'all' AS id, count(source)::BIGINT AS searched, count(*)::BIGINT AS declared, string_agg(CASE WHEN source IS NULL THEN member END, ',') AS missing
    FROM m LEFT JOIN p ON member = source"""
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    registry = sources.Registry([sources.Collection("all", members=("src1", "src3", "nowhere", "src5"))])
    indexed = T(spark, sf, "documents").select(F.col("source").alias("collection"))
    return sources.coverage(registry.table(spark), indexed).select("id", "searched", "declared", F.array_join("missing", ",").alias("missing"))


@query("SELECT source AS id FROM documents GROUP BY source UNION ALL SELECT 'two' AS id")
def available_collections(spark: SparkSession, sf: str) -> DataFrame:
    docs = T(spark, sf, "documents").select(F.col("source").alias("collection"))
    own = docs.distinct().select(F.col("collection").alias("id"), F.array().cast("array<string>").alias("members"))
    rows = [("two", ["src1", "src2"]), ("one", ["src1", "gone"]), ("none", ["gone"])]
    return sources.available(own.unionByName(spark.createDataFrame(rows, "id string, members array<string>")), docs)


@query("SELECT conv_id, turn, length(trim(text)) BETWEEN 3 AND 500 AS valid FROM conversations WHERE length(trim(text)) BETWEEN 3 AND 500")
def valid_questions(spark: SparkSession, sf: str) -> DataFrame:
    c = T(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return query_prep.valid_questions(c).select("conv_id", "turn", F.lit(True).alias("valid"))


# Rerank and topics ---------------------------------------------------------------------


@query(
    f"""WITH {_PAIRS}, h AS (SELECT *, CASE WHEN pos = (query_id // {_EVERY}) % 12 + 1 THEN 1 WHEN pos = 1 THEN 2 ELSE 2 + pos END AS k FROM r WHERE pos <= 12)
    SELECT query_id, vec_id, row_number() OVER w AS pos FROM h WINDOW w AS (PARTITION BY query_id ORDER BY k) QUALIFY row_number() OVER w <= 5"""
)
def rerank_order(spark: SparkSession, sf: str) -> DataFrame:
    """Replies that name a passage by the query and then the first, with a repeat and one out of range."""
    hits = _ranked(spark, sf, 12).withColumn("lexical", F.lit(False)).withColumn("named", F.lit(False))
    named = (F.floor(F.col("query_id") / _EVERY) % 12 + 1).cast("string")
    reply = F.concat(F.lit("Sure: ["), named, F.lit(", 1, "), named, F.lit(", 99] ok"))
    said = hits.select("query_id").distinct().withColumn("order", rerank.parse_order(reply, F.lit(12)))
    out = rerank.apply_order(hits.select("query_id", "ord", "pos", "score", "lexical", "named"), said)
    return out.select("query_id", F.col("ord").alias("vec_id"), F.col("pos").cast("long").alias("pos"))


@query()
def topics(spark: SparkSession, sf: str) -> DataFrame:
    hits = _ranked(spark, sf, 12).select("query_id", "pos", F.col("label").cast("string").alias("code"), F.concat(F.lit("rules on "), F.col("label").cast("string")).alias("title"), "score", F.lit(False).alias("lexical"))
    return clarify.topics(hits).select("query_id", "topic", "label", F.array_join("codes", ",").alias("codes"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_PAIRS} SELECT query_id, CASE WHEN max(CASE WHEN pos = 1 THEN s END) < 0.36 THEN 'refuse' WHEN count(DISTINCT label) <= 1 THEN 'answer'
    WHEN max(CASE WHEN pos = 1 THEN s END) >= 0.40 THEN 'answer' ELSE 'clarify' END AS decision FROM r WHERE pos <= 12 GROUP BY query_id"""
)
def clarify_decision(spark: SparkSession, sf: str) -> DataFrame:
    hits = _ranked(spark, sf, 12).select("query_id", "pos", F.col("label").cast("string").alias("code"), F.col("label").cast("string").alias("title"), "score", F.lit(False).alias("lexical"))
    settings = Settings(clarify_min_score=0.36, clarify_max_topics=12)
    return clarify.decide(hits, clarify.topics(hits, settings), F.lit(0.40), settings)


# Answers ----------------------------------------------------------------------------------


@query(
    f"""SELECT conv_id, turn, turn % 3 = 0 AS refused, turn % 3 <> 2 AS mentioned FROM conversations"""
)
def refusal_flag(spark: SparkSession, sf: str) -> DataFrame:
    no = F.lit(text.REFUSAL)
    built = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## Answer\n\n** "), no, F.lit(". "), F.col("text")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Well: "), F.col("text"), no))
        .otherwise(F.col("text"))
    )
    return T(spark, sf, "conversations").select("conv_id", "turn", text.is_refusal(built).alias("refused"), text.mentions_refusal(built).alias("mentioned"))


@query(
    r"""SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\*\*', '', 'g') AS span FROM documents
    WHERE length(text) >= 60 AND NOT contains(text, '"') AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 25 AND NOT contains(text, '*')"""
)
def quoted_spans(spark: SparkSession, sf: str) -> DataFrame:
    d = T(spark, sf, "documents").filter((F.length("text") >= 60) & ~F.contains("text", F.lit('"')) & ~F.contains("text", F.lit("*")))
    built = F.concat(F.lit('It says "'), F.col("text"), F.lit('" and "short".'))
    return d.select("doc_id", F.explode(text.quoted_spans(built)).alias("span"))


def _coded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Answers that name codes, and passages with codes, built of orders."""
    o = T(spark, sf, "orders")
    a, b = (F.col("o_orderkey") % 97).cast("string"), (F.col("o_custkey") % 50).cast("string")
    said = F.concat(F.lit("לפי הוראה 7."), a, F.lit("."), b, F.lit(". וגם הוראה 8."), b, F.lit(".1 (הוראה 3.4)."))
    answers = o.select(F.col("o_orderkey").alias("query_id"), said.alias("text"))
    code = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("7."), a, F.lit("."), b)).otherwise(F.concat(F.lit("7."), a))
    passages = o.select(F.col("o_orderkey").alias("query_id"), F.lit("c").alias("collection"), code.alias("code"), code.alias("title"), F.lit("t").alias("text"), F.lit(1).alias("pos"), F.lit(0.5).alias("score"))
    return answers, passages


@query("SELECT o_orderkey AS query_id, '7.' || (o_orderkey % 97) || '.' || (o_custkey % 50) AS code FROM orders WHERE o_orderkey % 2 = 0")
def cited_documents(spark: SparkSession, sf: str) -> DataFrame:
    answers, passages = _coded(spark, sf)
    return answer.cited_hits(answers, passages, F.lit("instruction")).select("query_id", "code")


@query("SELECT o_orderkey AS query_id, '8.' || (o_custkey % 50) || '.1' AS code FROM orders")
def unverified_codes(spark: SparkSession, sf: str) -> DataFrame:
    return answer.unverified_codes(*_coded(spark, sf))


_QUOTE = "length(text) >= 80 AND NOT contains(text, '\"') AND NOT contains(text, '*')"


@query(f"SELECT doc_id AS query_id, 'other' AS code FROM documents WHERE {_QUOTE} AND doc_id % 2 = 1")
def quoted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that quote their second passage; the even ones cite it too."""
    d = texts(spark, sf, "documents").filter(_QUOTE)
    answers = d.select(F.col("doc_id").alias("query_id"), F.concat(F.lit('as "'), F.col("text"), F.lit('"')).alias("text"))
    one = lambda code, body, pos: d.select(F.col("doc_id").alias("query_id"), F.lit("c").alias("collection"), F.lit(code).alias("code"), F.lit(code).alias("title"), body.alias("text"), F.lit(pos).alias("pos"), F.lit(0.1).alias("score"))
    passages = one("cited", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("nothing")), 1).unionByName(one("other", F.col("text"), 2))
    cited = d.select(F.col("doc_id").alias("query_id"), F.lit("cited").alias("code"))
    return answer.quoted_documents(answers, cited, passages).select("query_id", "code")


@query(
    """WITH p(route, price_in, price_out) AS (VALUES ('click', 1.0, 5.0), ('view', 0.28, 0.42), ('error', 0.5, 2.0))
    SELECT event_type AS route, round(sum(value * 1000 / 1e6 * price_in + value * 100 / 1e6 * price_out), 6) AS cost_usd FROM events JOIN p ON route = event_type GROUP BY event_type"""
)
def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 1.0, 5.0), ("view", 0.28, 0.42), ("error", 0.5, 2.0)], "route string, price_in double, price_out double")
    usage = T(spark, sf, "events").select(F.col("event_type").alias("route"), (F.col("value") * 1000).alias("input_tokens"), (F.col("value") * 100).alias("output_tokens"))
    return answer.with_cost(usage, prices).filter("cost_usd is not null").groupBy("route").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


# Evaluation -------------------------------------------------------------------------------


@query(
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), f AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM benchmark)
    SELECT doc_id, item_id FROM n JOIN f ON contains(replace(t, ' %', '%'), replace(b, ' %', '%'))"""
)
def fact_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts found in documents: each document is searched for every item of the bounded fact set."""
    facts = T(spark, sf, "benchmark").select("item_id", text.compare_form(F.col("text")).alias("fact"))
    docs = texts(spark, sf, "documents").select("doc_id", text.compare_form(F.col("text")).alias("body"))
    return containing(docs, facts)


def _eval_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lab = T(spark, sf, "labels")
    gold = lab.select(F.col("doc_id").alias("id"), F.concat(F.lit("c"), (F.col("doc_id") % 7).cast("string")).alias("expect"))
    code = lambda k: F.concat(F.lit("c"), ((F.col("doc_id") * k) % 7).cast("string"))
    ranked = F.when(F.col("toxic") == 0, F.array(code(3), code(1), code(3), code(2)))
    answers = lab.select(F.col("doc_id").alias("query_id"), F.array(code(3), code(5), code(1)).alias("retrieved_codes"), ranked.alias("ranked_codes"))
    return gold, answers


_EVAL = """WITH b AS (SELECT doc_id, toxic, quality, doc_id % 7 AS e, (doc_id * 3) % 7 AS r1, doc_id % 7 AS r2, (doc_id * 5) % 7 AS r5, (doc_id * 2) % 7 AS r4 FROM labels),
    m AS (SELECT *, true AS recall, toxic = 0 AND e = r1 AS top1, toxic = 0 AS top3, CASE WHEN toxic <> 0 THEN 0.0 WHEN e = r1 THEN 1.0 ELSE 0.5 END AS rr FROM b)"""


@query(_EVAL + " SELECT count(*) AS n, round(avg(recall::INT), 6) AS recall, round(avg(top1::INT), 6) AS top1, round(avg(top3::INT), 6) AS top3, round(avg(rr), 6) AS mrr FROM m")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluate.rank_metrics(evaluate.gold_rows(*_eval_rows(spark, sf)))
    return metrics.select("n", *(F.round(c, 6).alias(c) for c in ("recall", "top1", "top3", "mrr")))


@query(
    _EVAL + """, s AS (SELECT CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'ok' WHEN toxic <> 0 THEN 'ranker-dropped' WHEN doc_id % 5 = 0 THEN 'refused-though-ranked'
      WHEN doc_id % 2 = 0 THEN 'answered-cited-other' ELSE 'right-doc-wrong-value' END AS stage FROM m WHERE doc_id % 11 <> 0)
    SELECT stage, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY stage"""
)
def failure_stage(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.gold_rows(*_eval_rows(spark, sf)).join(T(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), "quality"), "query_id")
    rows = rows.withColumn("correct", (F.col("quality") == 1) & (F.col("query_id") % 3 == 0)).withColumn("refused", F.col("query_id") % 5 == 0)
    rows = rows.withColumn("expect_cited", F.col("query_id") % 2 != 0).withColumn("fact_method", F.lit("model")).withColumn("judge_failed", F.col("query_id") % 11 == 0)
    return evaluate.failure_shares(rows).select("stage", "n", F.round("share", 6).alias("share"))


@query(
    """SELECT quality, count(*) AS scorable, count(*) FILTER (WHERE toxic = 0) AS correct, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM labels WHERE doc_id % 4 <> 0 AND doc_id % 9 <> 0 GROUP BY quality"""
)
def answer_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = T(spark, sf, "labels").select(
        "quality", (F.col("toxic") == 0).alias("correct"), F.when(F.col("doc_id") % 4 == 0, "skipped").otherwise("literal").alias("fact_method"),
        F.when(F.col("doc_id") % 9 == 0, True).alias("judge_failed"),
    )
    return evaluate.accuracy(rows, ["quality"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    """WITH o AS (SELECT event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value))
    SELECT event_type, any_value(n) AS n, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.9)) THEN value END) AS p90
    FROM o GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.exact_percentiles(T(spark, sf, "events"), "value", ["event_type"], [0.5, 0.9])


_CALLS = """c AS (SELECT user_id AS query_id, event_type AS stage, CASE event_id % 3 WHEN 0 THEN 'wait' WHEN 1 THEN 'rejected' ELSE 'region' END AS kind, floor(value)::BIGINT AS ms FROM events)"""


@query(
    f"""WITH {_CALLS} SELECT stage, sum(CASE WHEN kind = 'wait' THEN ms ELSE 0 END)::BIGINT AS wait_ms, count(*) FILTER (WHERE kind = 'wait') AS retries
    FROM c WHERE kind <> 'region' GROUP BY stage"""
)
def wait_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.wait_by_stage(evaluate.retry_ledger(_calls(spark, sf)))


@query(f"WITH {_CALLS} SELECT stage AS region, count(*) AS calls FROM c WHERE kind = 'region' GROUP BY stage")
def calls_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calls_by_region(evaluate.retry_ledger(_calls(spark, sf)))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("wait"), F.lit("rejected"), F.lit("region")), (F.col("event_id") % 3 + 1).cast("int"))
    return T(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("stage"), kind.alias("kind"), F.floor("value").alias("ms"), F.col("event_type").alias("reason"))


@query(
    """WITH f AS (SELECT event_type, true AS complete, bool_and(user_id % 2 <> 0 OR value >= 1) AS stages_ran, count(*) FILTER (WHERE value > 300) = 0 AS no_failures,
      count(*) FILTER (WHERE event_type = 'error' AND value > 50) = 0 AS no_judge_failures, count(*) AS n FROM events GROUP BY event_type),
    g AS (SELECT event_type, n % 2 = 0 AS complete, stages_ran, no_failures, no_judge_failures FROM f)
    SELECT event_type, complete, stages_ran, no_failures, no_judge_failures, complete AND stages_ran AND no_failures AND no_judge_failures AS valid FROM g"""
)
def run_validity(spark: SparkSession, sf: str) -> DataFrame:
    """One run for each kind of event; runs of an odd number of rows lack one."""
    e = T(spark, sf, "events")
    out = None
    for r in e.groupBy("event_type").agg(F.count("*").alias("n")).collect():  # a handful of kinds
        rows = e.filter(F.col("event_type") == r["event_type"])
        facts = rows.select((F.col("value") >= 1).alias("reranked"), (F.col("user_id") % 2 == 0).alias("due"), (F.col("value") > 300).alias("failed"), ((F.col("event_type") == "error") & (F.col("value") > 50)).alias("judge_failed"))
        one = evaluate.validity(facts, r["n"] + r["n"] % 2, F.col("due")).withColumn("event_type", F.lit(r["event_type"]))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH m AS (SELECT 'raw' AS measure, floor(value * 10)::BIGINT AS ms FROM events UNION ALL SELECT 'work', greatest(0, floor(value * 10) - floor(value))::BIGINT FROM events
      UNION ALL SELECT 'net', greatest(0, floor(value * 10) - floor(value) - user_id % 500)::BIGINT FROM events),
    o AS (SELECT measure, ms, row_number() OVER (PARTITION BY measure ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY measure) AS n FROM m)
    SELECT measure, any_value(n) AS n, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN ms END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.9)) THEN ms END) AS p90 FROM o GROUP BY measure"""
)
def first_token_latency(spark: SparkSession, sf: str) -> DataFrame:
    e = T(spark, sf, "events")
    rows = e.select(F.floor(F.col("value") * 10).alias("first_token_ms"), F.floor("value").alias("wait_ms"), (F.col("user_id") % 500).alias("rejected_ms"))
    return evaluate.latency(rows)


_JUDGED = """b AS (SELECT doc_id, text, lang, doc_id % 6 AS kind FROM documents WHERE length(text) >= 40 AND NOT contains(text, '%')),
    j AS (SELECT doc_id, kind, kind = 0 AS skipped, kind IN (1, 5) AS held, kind = 2 AS bare, kind IN (3, 4) AS open FROM b)"""


@query(
    f"""WITH {_JUDGED} SELECT doc_id AS query_id, CASE WHEN skipped THEN 'skipped' WHEN open THEN 'model' ELSE 'literal' END AS fact_method, held AS fact_found,
    open AS judge_failed, kind = 2 OR kind = 5 AS refused, doc_id % 2 = 0 AS expect_cited, held AND doc_id % 2 = 0 AND doc_id % 5 <> 0 AS correct FROM j"""
)
def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without a fact, that state it, that refuse (barely, or and then state it), and that only a model could judge."""
    d = texts(spark, sf, "documents").filter((F.length("text") >= 40) & ~F.contains("text", F.lit("%")))
    kind, fact = F.col("doc_id") % 6, F.concat(F.lit("fact no "), F.col("doc_id").cast("string"), F.lit(" holds"))
    said = (
        F.when(kind == 2, F.concat(F.lit(text.REFUSAL), F.lit(".")))
        .when(kind == 5, F.concat(F.lit(text.REFUSAL), F.lit(". "), F.col("text"), F.lit("\n"), fact))
        .when(kind == 1, F.concat(F.col("text"), F.lit(" "), F.replace(fact, F.lit(" no "), F.lit("\n no  "))))
        .otherwise(F.col("text"))
    )
    rows = d.select(
        F.col("doc_id").alias("query_id"), F.lit("q").alias("q"), F.lit("k").alias("kind"), F.when(kind != 0, fact).alias("fact"), F.lit(False).alias("weak_fact"), said.alias("text"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("9.9.9"))).alias("unverified"),
    )
    supported = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"))
    return evaluate.judge(rows, supported, None).select("query_id", "fact_method", "fact_found", "judge_failed", "refused", "expect_cited", "correct")


@query(
    """WITH b AS (SELECT doc_id, trim(regexp_replace(substr(text, 11, 40), '\\s+', ' ', 'g')) AS fact FROM documents)
    SELECT doc_id AS query_id FROM b WHERE doc_id % 4 = 0 OR (doc_id % 4 <> 3 AND fact <> '' AND doc_id % 3 <> 0)"""
)
def supported_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that cite the expected document, or another one that holds the fact, unless the fact is weak."""
    d = texts(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("code"), F.col("text").alias("body"))
    kind = F.col("doc_id") % 4
    expect = F.when(kind == 0, F.col("code")).otherwise(F.lit("none"))
    rows = d.select(F.col("doc_id").alias("query_id"), expect.alias("expect"), F.substring("body", 11, 40).alias("fact"), (F.col("doc_id") % 3 == 0).alias("weak_fact"))
    cited = d.select(F.col("doc_id").alias("query_id"), F.when(kind == 3, F.lit("other")).otherwise(F.col("code")).alias("code"))
    return evaluate.supports_fact(rows, cited, d.select("code", "body"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS refused_strict, turn % 3 <> 2 AS refused_loose FROM conversations WHERE turn % 4 <> 3")
def control_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Control questions, refused, refused by mention only, or answered; every fourth turn is no control."""
    no = F.lit(text.REFUSAL)
    c = T(spark, sf, "conversations").withColumn("key", F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("**"), no)).when(F.col("turn") % 3 == 1, F.concat(F.lit("Well, "), no)).otherwise(F.col("text"))
    answers = c.select(F.col("key").alias("query_id"), said.alias("text"))
    return evaluate.control_rows(c.filter("turn % 4 <> 3").select(F.col("key").alias("id"), "conv_id", "turn"), answers).select("conv_id", "turn", "refused_strict", "refused_loose")


@query("SELECT doc_id, doc_id % 3 = 0 AS hebrew FROM documents")
def hebrew_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" מה"))).otherwise(F.col("text"))
    return T(spark, sf, "documents").select("doc_id", text.is_hebrew(asked).alias("hebrew"))


@query(
    """SELECT p_partkey, p_size % 3 <> 2 AS same FROM part"""
)
def same_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that hold one another but for quotes, that share all but one of their words, and that share one."""
    kind, key = F.col("p_size") % 3, F.col("p_partkey").cast("string")
    one = F.concat(F.lit("rules of "), key, F.lit(" alpha beta gamma"))
    other = F.when(kind == 0, F.concat(F.lit('new "'), one, F.lit('" (draft)'))).when(kind == 1, F.concat(F.lit("gamma  beta alpha rules omega"), key)).otherwise(F.concat(F.lit("alpha delta epsilon "), key))
    return T(spark, sf, "part").select("p_partkey", clarify.same_topic(one, other).alias("same"))


@query(
    """WITH k AS (SELECT o_orderkey AS q, o_orderkey % 4 AS kind FROM orders)
    SELECT q AS query_id, CASE WHEN kind = 1 THEN 'b' ELSE 'a' END AS code, CASE WHEN kind = 1 THEN 0.4 WHEN kind = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS score FROM k WHERE kind <> 3"""
)
def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that cite nothing, the second or the first of their passages, and refusals: what each rests on."""
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 4).alias("kind"))
    said = F.when(F.col("kind") == 1, "see b.").when(F.col("kind") == 2, "see a.").when(F.col("kind") == 3, F.concat(F.lit(text.REFUSAL), F.lit(" a"))).otherwise("nothing named")
    answers = o.select("query_id", said.alias("text"))
    one = lambda code, pos, score: o.select("query_id", F.lit("c").alias("collection"), F.lit(code).alias("code"), F.lit(code).alias("title"), F.lit("t").alias("text"), F.lit(pos).alias("pos"), F.lit(score).alias("score"))
    passages = one("a", 1, 0.7).unionByName(one("b", 2, 0.4))
    hits = one("a", 1, 0.9)
    return answer.sources(answers, hits, passages, "page").select("query_id", "code", "score")


@query("SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE c END AS code FROM orders, (VALUES ('a'), ('b')) v(c) WHERE o_orderkey % 3 <> 0 OR c = 'b'")
def chosen_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Every third question chooses a topic, every next one a topic that hits nothing."""
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    hits = o.select("query_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("code"))
    choices = o.filter("query_id % 3 <> 2").select("query_id", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("b"), F.lit("x"))).otherwise(F.array(F.lit("none"))).alias("topic_codes"))
    return answer.choose_topics(hits, choices).select("query_id", "code")


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN NULL WHEN 2 THEN 'it''s ' || p_type ELSE p_brand END AS translation,
    CASE p_size % 4 WHEN 0 THEN 'all about ' || p_name WHEN 1 THEN 'first of ' || p_partkey || '|second of ' || p_partkey ELSE '' END AS rewrites FROM part"""
)
def usable_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Translations (quoted, too long, plain, padded) and rewrites (one with a repeat of the question, three numbered, too short, too long)."""
    kind, key = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    reply = F.when(kind == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(kind == 1, F.repeat(F.col("p_name"), 80)).when(kind == 2, F.concat(F.lit(" it's "), "p_type")).otherwise(F.concat(F.lit("\n "), "p_brand", F.lit("\n")))
    lines = (
        F.when(kind == 0, F.concat("p_name", F.lit("\nall about "), "p_name"))
        .when(kind == 1, F.concat(F.lit("1. first of "), key, F.lit("\r\n- second of "), key, F.lit("\n3. third of "), key))
        .when(kind == 2, F.lit("short\n\n"))
        .otherwise(F.repeat(F.lit("far too long "), 20))
    )
    return T(spark, sf, "part").select(
        "p_partkey", query_prep.usable_translation(reply).alias("translation"), F.array_join(query_prep.usable_rewrites(lines, F.col("p_name")), "|").alias("rewrites")
    )


@query(
    """SELECT conv_id, turn, turn % 4 < 2 AS truncated, CASE turn % 3 WHEN 0 THEN 'answers' WHEN 1 THEN 'explains' ELSE 'failed' END AS verdict FROM conversations"""
)
def reply_checks(spark: SparkSession, sf: str) -> DataFrame:
    stop = F.element_at(F.array(F.lit("max_tokens"), F.lit("length"), F.lit("stop"), F.lit(None).cast("string")), (F.col("turn") % 4 + 1).cast("int"))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n עונה "), F.col("text"))).when(F.col("turn") % 3 == 1, F.lit("מסביר.")).otherwise(F.col("text"))
    return T(spark, sf, "conversations").select("conv_id", "turn", answer.truncated(stop).alias("truncated"), answer.quote_check_verdict(said).alias("verdict"))


@query(
    """WITH m AS (SELECT p_brand, p_partkey, p_name, p_type, p_size FROM part WHERE p_size % 5 <> 0)
    SELECT p_partkey::VARCHAR AS code, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS title, lower(p_type) || '|' || p_size AS keywords,
    CASE p_size % 3 WHEN 0 THEN 'http://base/x.' || p_partkey WHEN 1 THEN 'http://base/H.' || p_partkey ELSE 'http://own/' || p_partkey END AS source_url FROM m"""
)
def manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest for each brand: rows with and without code, title, file and link."""
    p = T(spark, sf, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    entry = F.struct(
        F.when(size % 5 != 0, key).alias("code"), F.when(size % 2 == 0, F.col("p_name")).alias("title"),
        F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ;, "), size.cast("string")).alias("keywords"),
        F.when(size % 3 == 0, F.concat(F.lit("x."), key, F.when(size % 2 == 0, F.lit(".DOCX")).otherwise(F.lit(".pdf")))).alias("file"),
        F.when(size % 3 == 2, F.concat(F.lit("http://own/"), key)).alias("url"),
    )
    raw = p.groupBy("p_brand").agg(F.collect_list(entry).alias("documents")).withColumn("downloaded", F.lit(None).cast("string"))
    rows = store.manifest_rows(raw, "http://base/")
    return rows.select("code", "title", F.array_join("keywords", "|").alias("keywords"), "source_url")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src4') AND doc_id % 2 = 0 OR source = 'src2'")
def reusable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of collections that were embedded by the same transport with the same setting."""
    metas = [("src1", "t", False), ("src4", "t", None), ("src2", "t", False), ("src3", "other", False), ("src5", "t", True)]
    meta = spark.createDataFrame(metas, "collection string, embed_transport string, contextual boolean")
    d = T(spark, sf, "documents").filter("doc_id % 2 = 0 or source not in ('src1', 'src4')").select("doc_id", F.col("source").alias("collection"))
    return store.reusable(d, meta, "t", False).select("doc_id")


@query(
    """WITH r AS (SELECT doc_id, doc_id % 3 = 0 AS reused, ceil(length(text) / 4.0) AS est FROM documents)
    SELECT 7::BIGINT AS documents, count(*) AS chunks, count(*) FILTER (WHERE NOT reused) AS embedded, count(*) FILTER (WHERE reused) AS reused,
    sum(CASE WHEN NOT reused THEN est ELSE 0 END)::BIGINT AS tokens, round(sum(CASE WHEN NOT reused THEN est ELSE 0 END) / 1e6 * 0.02, 9) AS cost_usd FROM r"""
)
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A run whose model tells no tokens: they are estimated for what was embedded."""
    d = T(spark, sf, "documents").select(F.col("text").alias("view"), (F.col("doc_id") % 3 == 0).alias("reused"), F.lit(0).cast("long").alias("tokens"))
    return ingest.summary(d, 7).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    """WITH b AS (SELECT doc_id AS q, doc_id % 6 AS k FROM labels)
    SELECT q AS query_id, 'refusal-holds-fact' AS "check" FROM b WHERE k = 1 UNION ALL SELECT q, 'weak-fact-failed' FROM b WHERE k IN (3, 5)"""
)
def judge_self_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals that hold the fact or don't, weak facts that failed or didn't, right answers."""
    q, k = F.col("doc_id"), F.col("doc_id") % 6
    fact = F.concat(F.lit("fact "), q.cast("string"))
    codes = F.array(F.lit("a"))
    rows = T(spark, sf, "labels").select(
        q.alias("query_id"), (k == 0).alias("correct"), codes.alias("retrieved_codes"), codes.alias("ranked_codes"), F.lit("a").alias("expect"), k.isin(1, 2, 3).alias("refused"),
        F.lit(True).alias("expect_cited"), fact.alias("fact"), k.isin(3, 5).alias("weak_fact"), F.when(k == 2, F.lit("nothing")).otherwise(F.concat(F.lit("no, but "), fact)).alias("text"),
    )
    return evaluate.judge_self_checks(rows)


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'new' ELSE 'old' END AS source, turn % 2 = 0 AS refused FROM conversations"""
)
def rejudged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every third row judged anew; refusal flags are taken from the text again."""
    key = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    said = F.when(F.col("turn") % 2 == 0, F.lit(text.REFUSAL)).otherwise(F.col("text"))
    c = T(spark, sf, "conversations").select(key.alias("query_id"), "conv_id", "turn", said.alias("text"), F.lit(None).cast("boolean").alias("refused"))
    done = evaluate.rejudged(c.withColumn("source", F.lit("old")), c.filter("turn % 3 = 0").withColumn("source", F.lit("new")))
    return done.select("conv_id", "turn", "source", "refused")


@query(
    """WITH k AS (SELECT o_orderkey AS q, o_orderkey % 3 AS n FROM orders)
    SELECT q AS query_id, md5('[1] מתוך טופס a — "t":' || chr(10) || 'one' || CASE WHEN n > 0 THEN chr(10) || chr(10) || '[2] מתוך הוראה b — "t":' || chr(10) || 'מילות מפתח רשמיות: k, m' || chr(10) || 'two' ELSE '' END
      || chr(10) || chr(10) || '---' || chr(10) || 'Cite only: a' || CASE WHEN n > 0 THEN ', b' ELSE '' END || chr(10) || 'Question: q' || q) AS digest FROM k"""
)
def user_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of one and two passages, with and without keywords."""
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    none = F.lit(None).cast("array<string>")
    one = lambda rows, code, pos, body, words, kind: rows.select("query_id", F.lit("c").alias("collection"), F.lit(code).alias("code"), F.lit("t").alias("title"), F.lit(body).alias("text"), words.alias("keywords"), F.lit(kind).cast("string").alias("doctype"), F.lit(pos).alias("pos"))
    passages = one(o, "a", 1, "one", none, "Form").unionByName(one(o.filter("query_id % 3 > 0"), "b", 2, "two", F.array(F.lit("k"), F.lit("m")), None))
    asked = o.withColumn("question", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    return answer.user_messages(asked, passages).select("query_id", F.md5("message").alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.resume(T(spark, sf, "documents").select("doc_id"), T(spark, sf, "labels"), "doc_id")
