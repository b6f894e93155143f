"""Lexical search: postings, BM25 and rank fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lodestone.config import DEFAULT, Settings
from lodestone.functions.text import raw_words, tokenise, word_tokens
from lodestone.functions.tokens import Tokens
from lodestone.sources.shared import cut
from lodestone.sources.spread import spread

BLOCK_QUERIES = 512
BLOCK_TERMS = 50_000
#: Rows times queries that are scored at once.
BATCH_CELLS = 1 << 20
#: Asked terms, or keys of rows that share them, that are sent to the tasks at most.
SENT_TERMS = 500_000
#: Rows of postings that a worker gives at once, beside those of its last text; texts whose terms it gives at once.
GIVEN_ROWS, GIVEN_TEXTS = 50_000, 1_000


def chunk_words(settings: Settings = DEFAULT) -> Column:
    """What a chunk is searched by: code, title, keywords, context (if on) and text."""
    parts = [F.col("code"), F.col("title"), F.array_join("keywords", " ")]
    if settings.contextual:
        parts.append(F.col("context"))
    filled = [F.when(c != "", c) for c in (*parts, F.col("text"))]
    return F.concat_ws(" ", *filled)


def token_rows(docs: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    """(keys, term), a row per token.  Words are exploded before they are looked at, so that all of it is compiled code."""
    text = docs.select(*keys, F.coalesce(words, F.lit("")).alias("_text"))
    raw = spread(text).select(*keys, F.explode(raw_words(F.col("_text"))).alias("_raw"))
    return raw.select(*keys, F.explode(word_tokens(F.col("_raw"))).alias("term"))


def _texts(docs: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.coalesce(words, F.lit("")).alias("_text"))


def _row_postings(text: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf, length) of each row by itself, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            rows: list[int] = []
            terms: list[str] = []
            tf: list[int] = []
            length: list[int] = []
            for row, value in enumerate(batch.column(len(keys))):
                found = tokens.count(value.as_py())
                rows += [row] * len(found)
                terms += found
                tf += found.values()
                length += [sum(found.values())] * len(found)
                if rows and (len(rows) >= GIVEN_ROWS or row + 1 == batch.num_rows):
                    own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(keys)]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(length, pa.int64())], names=[*keys, "term", "tf", "length"])
                    rows, terms, tf, length = [], [], [], []

    shape = StructType([*(text.schema[c] for c in keys), StructField("term", StringType()), StructField("tf", LongType()), StructField("length", LongType())])
    return spread(text).mapInArrow(run, shape)


def postings(docs: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    """(keys, term, tf, length): one pass over the text.

    A row whose keys no other row has is done with where it is read.  Only rows
    that share their keys are put together by shuffle.
    """
    text = _texts(docs, words, keys)
    shared = cut(docs.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*(F.col(c).alias(f"_again_{c}") for c in keys)))
    n = shared.count()
    if not n:
        return _row_postings(text, keys)
    own = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_again_{c}")) for c in keys))
    some = F.broadcast(shared) if n <= SENT_TERMS else shared
    once, again = (text.join(some, own, how) for how in ("left_anti", "left_semi"))
    tf = _row_postings(again, keys).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))
    return _row_postings(once, keys).unionByName(tf.withColumn("length", F.sum("tf").over(Window.partitionBy(*keys))))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, text) -> (query_id, place, term): each distinct token with its place."""
    tokens = F.array_distinct(tokenise(F.col("text")))
    return queries.select("query_id", F.posexplode(tokens).alias("place", "term"))


def asked_terms(docs: DataFrame, words: Column, keys: list[str], asked: DataFrame) -> DataFrame:
    """(keys, length, terms array<struct<term, tf>>): of each row its length and the asked terms that it holds.

    The text is read once.  What nobody asks for is only counted, where the text
    is read.  The asked terms are sent to the tasks; if there are too many of
    them, tokens are joined to them instead.
    """
    known = cut(asked.select("term").distinct())
    if known.count() > SENT_TERMS:
        return _joined_terms(docs, words, keys, known)
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in known.toLocalIterator()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(sent.value)
        for whole in batches:
            for start in range(0, whole.num_rows, GIVEN_TEXTS):
                batch = whole.slice(start, GIVEN_TEXTS)
                counts = [tokens.count_asked(value.as_py()) for value in batch.column(len(keys))]
                lists = [[{"term": t, "tf": n} for t, n in found.items()] for _, found in counts]
                columns = [*batch.columns[: len(keys)], pa.array([n for n, _ in counts], pa.int64()), pa.array(lists, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "length", "terms"])

    text = _texts(docs, words, keys)
    kind = ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())]))
    rows = spread(text).mapInArrow(run, StructType([*(text.schema[c] for c in keys), StructField("length", LongType()), StructField("terms", kind)]))
    put = rows.filter("length > 0").groupBy(*keys).agg(F.sum("length").alias("length"), F.collect_list("terms").alias("_lists"))
    every = F.flatten("_lists")
    count = lambda t: F.aggregate(F.filter(every, lambda x: x["term"] == t), F.lit(0), lambda n, x: n + x["tf"])
    merged = F.transform(F.array_distinct(F.transform(every, lambda x: x["term"])), lambda t: F.struct(t.alias("term"), count(t).alias("tf")))
    return put.select(*keys, "length", F.array_sort(F.when(F.size("_lists") == 1, F.col("_lists")[0]).otherwise(merged)).alias("terms"))


def _joined_terms(docs: DataFrame, words: Column, keys: list[str], known: DataFrame) -> DataFrame:
    known = known.withColumn("_asked", F.col("term"))
    counted = token_rows(docs, words, keys).join(known, "term", "left").groupBy(*keys, "_asked").agg(F.count("*").alias("tf"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_asked").isNotNull(), F.struct(F.col("_asked").alias("term"), F.col("tf").cast("int").alias("tf")))))
    return counted.groupBy(*keys).agg(F.sum("tf").alias("length"), listed.alias("terms"))


def corpus_stats(docs: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, avg_length) over all rows of ``docs``, with or without tokens; rows: (by, length) of those with some."""
    tokens = rows.groupBy(*by).agg(F.sum("length").alias("_t"))
    every = docs.groupBy(*by).agg(F.count("*").alias("n"))
    joined = every.join(tokens, by, "left") if by else every.withColumn("_t", F.lit(tokens.first()["_t"] or 0))
    return joined.select(*by, "n", (F.coalesce("_t", F.lit(0)) / F.col("n")).alias("avg_length"))


@dataclass
class _Block:
    """A block of queries as the executors need it: who asks for a term and where, and each corpus' weights."""

    query_ids: list
    terms: list[str]
    begins: np.ndarray  # of each term's askers in the two arrays below
    askers: np.ndarray
    places: np.ndarray
    idf: dict[tuple, np.ndarray]
    average: dict[tuple, float]


def _query_blocks(terms: DataFrame, queries: int, words: int) -> Iterator[list[tuple]]:
    """Rows (query_id, term, place) of whole queries, in blocks of at most so many queries and about so many terms."""
    block: list[tuple] = []
    seen = 0
    for row in terms.orderBy("query_id", "place").toLocalIterator():
        new = not block or row["query_id"] != block[-1][0]
        if new and (seen >= queries or len(block) >= words):
            yield block
            block, seen = [], 0
        seen += new
        block.append((row["query_id"], row["term"], row["place"]))
    if block:
        yield block


def _block(rows: list[tuple], by: list[str], df: DataFrame, stats: list) -> _Block:
    query_ids = list(dict.fromkeys(q for q, _, _ in rows))
    number = {q: i for i, q in enumerate(query_ids)}
    terms = sorted({t for _, t, _ in rows})
    place_of = {t: i for i, t in enumerate(terms)}
    told = sorted((place_of[t], number[q], p) for q, t, p in rows)
    of_term = np.array([t for t, _, _ in told])
    n = {tuple(r[c] for c in by): (r["n"], r["avg_length"]) for r in stats}
    idf = {key: np.zeros(len(terms)) for key in n}
    own = df.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    for r in df.join(F.broadcast(own), "term").toLocalIterator():  # at most the block's terms for each corpus
        key = tuple(r[c] for c in by)
        idf[key][place_of[r["term"]]] = math.log(1 + (n[key][0] - r["df"] + 0.5) / (r["df"] + 0.5))
    return _Block(query_ids, terms, np.searchsorted(of_term, np.arange(len(terms) + 1)), np.array([q for _, q, _ in told]), np.array([p for _, _, p in told]), idf, {k: v[1] for k, v in n.items()})


def _best_of_batch(block: _Block, k: int, k1: float, b: float, key: tuple, ords: np.ndarray, length: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[tuple]:
    """(query, ord, score, place) arrays: the best k rows of one corpus in a batch, query by query."""
    weight = block.idf[key][term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length[row] / block.average[key]))))
    times = (block.begins[1:] - block.begins[:-1])[term]
    at = np.repeat(block.begins[:-1][term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    cell = np.repeat(row, times) * len(block.query_ids) + block.askers[at]
    shape = (len(ords), len(block.query_ids))
    score = np.bincount(cell, weights=np.repeat(weight, times), minlength=shape[0] * shape[1]).reshape(shape)
    place = np.full(shape[0] * shape[1], 1 << 30)
    np.minimum.at(place, cell, block.places[at])
    place = place.reshape(shape)
    for q in np.nonzero((place < 1 << 30).any(axis=0))[0]:
        hit = np.nonzero(place[:, q] < 1 << 30)[0]
        if len(hit) > k:
            least = np.partition(score[hit, q], len(hit) - k)[len(hit) - k]
            hit = hit[score[hit, q] >= least]
        best = hit[np.lexsort((ords[hit], place[hit, q], -score[hit, q]))][:k]
        yield np.full(len(best), q), ords[best], score[best, q], place[best, q]


def bm25(
    docs: DataFrame, words: Column, queries: DataFrame, k: int, by: list[str] | None = None, settings: Settings = DEFAULT,
    block_queries: int = BLOCK_QUERIES, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(query_id, by, ord, score, rank) of each query's best k rows, by corpus.

    ``docs`` has the key ``ord`` (a long) and the corpus columns ``by``.  The
    text is tokenised once; of each row only its length and the terms that some
    query asks for are kept.  Queries are then taken in blocks of bounded size:
    each Arrow batch of rows scores a block as arrays and keeps its own best k,
    so that no pair of row and query is shuffled.  Ties go to the row that
    shares the earlier query term, then to the lower ``ord``.
    """
    by = by or []
    keys = [*by, "ord"]
    id_type = queries.schema["query_id"].dataType
    terms = cut(query_terms(queries))
    rows = cut(asked_terms(docs.withColumn("ord", F.col("ord").cast("long")), words, keys, terms))
    stats = corpus_stats(docs, rows, by).collect()  # one row for each corpus, a small dimension
    df = cut(rows.select(*by, F.explode("terms.term").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("df")))
    found = rows.filter(F.size("terms") > 0).select(*by, "ord", "length", F.col("terms.term").alias("term"), F.col("terms.tf").alias("tf"))
    by_schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"query_id {id_type.simpleString()}, {by_schema}ord long, score double, place int"
    id_arrow, by_arrow = to_arrow_type(id_type), [to_arrow_type(docs.schema[c].dataType) for c in by]
    k1, b = settings.bm25_k1, settings.bm25_b
    out = None
    for part in _query_blocks(terms, block_queries, block_terms):
        sent = docs.sparkSession.sparkContext.broadcast(_block(part, by, df, stats))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            wanted = pa.array(block.terms, pa.string())
            most = max(1, BATCH_CELLS // len(block.query_ids))
            for whole in batches:
                for start in range(0, whole.num_rows, most):
                    batch = whole.slice(start, most)
                    lists = batch.column(len(by) + 2)
                    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
                    known = pc.index_in(lists.flatten().cast(pa.string()), value_set=wanted)
                    good = known.is_valid().to_numpy(zero_copy_only=False)
                    if not good.any():
                        continue
                    row, term = row[good], known.filter(pa.array(good)).to_numpy()
                    tf = batch.column(len(by) + 3).flatten().to_numpy()[good].astype(float)
                    ords, length = (batch.column(len(by) + i).to_numpy().astype(t) for i, t in ((0, np.int64), (1, float)))
                    corpora = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))))) or [()] * batch.num_rows
                    for key in dict.fromkeys(corpora):
                        own = np.array([c == key for c in corpora])
                        if not own[row].any():
                            continue
                        renumbered = np.cumsum(own) - 1
                        mine = own[row]
                        parts = list(_best_of_batch(block, k, k1, b, key, ords[own], length[own], renumbered[row[mine]], term[mine], tf[mine]))
                        q, o, s, p = (np.concatenate(c) for c in zip(*parts))
                        columns = [pa.array([block.query_ids[i] for i in q.tolist()], id_arrow), *(pa.array([v] * len(q), t) for v, t in zip(key, by_arrow)), pa.array(o), pa.array(s), pa.array(p.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, names=["query_id", *by, "ord", "score", "place"])

        best = found.mapInArrow(run, schema)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema.replace(", place int", ", rank int"))
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "place", "ord")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("place")


def rrf(lists: DataFrame, keys: list[str], k: int = DEFAULT.rrf_k, by: str = "query_id") -> DataFrame:
    """(by, list, pos from 1, keys) -> (by, keys, score, first_list, first_pos, rank).

    Sum of 1 / (k + pos) over the lists, added in list order; ties go to what
    was seen first.
    """
    places = F.array_sort(F.collect_list(F.struct("list", "pos")))
    merged = lists.groupBy(by, *keys).agg(places.alias("places"))
    score = F.aggregate("places", F.lit(0.0), lambda s, p: s + F.lit(1.0) / (F.lit(k) + p["pos"]))
    scored = merged.select(by, *keys, score.alias("score"), F.col("places")[0]["list"].alias("first_list"), F.col("places")[0]["pos"].alias("first_pos"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), "first_list", "first_pos")
    return scored.withColumn("rank", F.row_number().over(w))
