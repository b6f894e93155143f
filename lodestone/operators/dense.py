"""Exact dense search: blocks of queries against all vectors.

Query vectors are sent to the executors up to a bound of bytes, and one scan of
the vectors serves all that are sent.  Every Arrow batch makes one matrix
product for each block of queries and tile of rows, and a task keeps the best k
per query of all that it has seen.  The best k of those are the exact best k of
all.  What a task holds is bounded: the vectors sent, k rows for each of them,
and one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine

BLOCK_VECTORS = 1024
#: Numbers that are sent at once: 64 MB.
SENT_NUMBERS = 8 << 20
#: Scores that are held at once: 8 MB.
TILE_SCORES = 1 << 20
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[list, np.ndarray]]:
    """(query ids, matrix) of at most ``size`` rows each; the variants of a query stay together."""
    ids: list = []
    rows: list = []
    for row in queries.select("query_id", "vector").orderBy("query_id").toLocalIterator():
        if len(rows) >= size and row["query_id"] != ids[-1]:
            yield ids, np.array(rows, dtype=float)
            ids, rows = [], []
        ids.append(row["query_id"])
        rows.append(row["vector"])
    if rows:
        yield ids, np.array(rows, dtype=float)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.full_like(m, np.nan), where=norms > 0)


def _firsts(ids: list) -> np.ndarray:
    """Where each id's vectors begin; equal ids stand together."""
    return np.array([i for i, x in enumerate(ids) if not i or x != ids[i - 1]])


def _rounds(blocks: Iterator[tuple[list, np.ndarray]]) -> Iterator[list[tuple[list, np.ndarray]]]:
    """Blocks that are sent together."""
    held, size = [], 0
    for ids, matrix in blocks:
        if held and size + matrix.size > SENT_NUMBERS:
            yield held
            held, size = [], 0
        held.append((ids, matrix))
        size += matrix.size
    if held:
        yield held


class _Best:
    """The best k rows so far of each query of a block: scores from the top, ties by ``ord``."""

    def __init__(self, names: list, first: np.ndarray, unit: np.ndarray, k: int) -> None:
        self.names, self.first, self.unit, self.k = names, first, unit, k
        self.score = np.full((len(names), k), -np.inf)
        self.ord = np.zeros((len(names), k), dtype=np.int64)

    def add(self, own: np.ndarray, ords: np.ndarray) -> None:
        """Rows of unit length; scores to twelve places, so that copies tie."""
        most = max(1, TILE_SCORES // len(self.unit))
        for start in range(0, len(ords), most):
            self._tile(own[start : start + most], ords[start : start + most])

    def _tile(self, own: np.ndarray, ords: np.ndarray) -> None:
        scores = self.unit @ own.T
        np.round(scores, 12, out=scores)
        scores[np.isnan(scores)] = -1.0
        np.maximum(scores, -1.0, out=scores)
        if len(self.first) < len(scores):
            scores = np.maximum.reduceat(scores, self.first, axis=0)
        k = self.k
        for q in np.nonzero(scores.max(axis=1) >= self.score[:, -1])[0]:
            s = scores[q]
            least = self.score[q, -1]
            if len(s) > k:
                least = max(least, np.partition(s, len(s) - k)[len(s) - k])
            near = np.nonzero(s >= least)[0]
            held = self.score[q] > -np.inf
            score, at = np.concatenate([self.score[q, held], s[near]]), np.concatenate([self.ord[q, held], ords[near]])
            best = np.lexsort((at, -score))[:k]
            self.score[q, : len(best)], self.ord[q, : len(best)] = score[best], at[best]

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, ord, score) of what is held, in batches of bounded size."""
        most = max(1, (1 << 16) // self.k)
        for start in range(0, len(self.names), most):
            score, ords = self.score[start : start + most], self.ord[start : start + most]
            q, at = np.nonzero(score > -np.inf)
            named = pa.array(self.names[start : start + most], kind).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([named, pa.array(ords[q, at]), pa.array(score[q, at])], names=["query_id", "ord", "score"])


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK_VECTORS) -> DataFrame:
    """(ord, embedding) and (query_id, vector) -> (query_id, ord, score, rank), rank from 1.

    A query may have several vectors: its score is the best of them.  Rows whose
    embedding is null or of another length are left out; a zero vector scores
    -1.  Ties go to the lower ``ord``.
    """
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, ord long, score double"
    out = None
    for sent_blocks in _rounds(_blocks(queries, block)):
        sent = vectors.sparkSession.sparkContext.broadcast([(list(dict.fromkeys(ids)), _firsts(ids), _unit(m)) for ids, m in sent_blocks])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [_Best(*block, k) for block in sent.value]
            for batch in batches:
                flat, width = batch.column(1), pc.list_value_length(batch.column(1))
                for dims in dict.fromkeys(h.unit.shape[1] for h in held):
                    good = pc.fill_null(pc.equal(width, dims), False)
                    ords = batch.column(0).filter(good).to_numpy(zero_copy_only=False)
                    if not len(ords):
                        continue
                    own = _unit(flat.filter(good).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims))
                    for h in held:
                        if h.unit.shape[1] == dims:
                            h.add(own, ords)
            for h in held:
                yield from h.rows(_TYPES[id_type])

        part = vectors.select(F.col("ord").cast("long").alias("ord"), "embedding").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ord) pairs with the score of each; null where the row has no vector of the query's length."""
    left = pairs.join(vectors.select("ord", "embedding"), "ord", "left").join(queries.select("query_id", "vector"), "query_id", "left")
    one = F.when(F.size("embedding") == F.size("vector"), F.coalesce(cosine(F.col("embedding"), F.col("vector")), F.lit(-1.0)))
    return left.withColumn("_s", one).groupBy("query_id", "ord").agg(F.greatest(F.lit(-1.0), F.max("_s")).alias("score"), F.max("_s").alias("_known")).select(
        "query_id", "ord", F.when(F.col("_known").isNotNull(), F.col("score")).alias("score")
    )


def same_space(left: DataFrame, right: DataFrame) -> DataFrame:
    """Index rows (collection, embed_model, dims) against query rows (embed_model, dims): ``comparable`` by collection."""
    joined = left.alias("l").join(right.alias("r"), F.col("l.embed_transport") == F.col("r.embed_transport"), "left")
    same = (F.col("l.dims") == F.col("r.dims")) & ((F.col("l.embed_model") == "") | (F.col("l.embed_model") == F.col("r.embed_model")))
    return joined.select("l.collection", F.coalesce(same, F.lit(False)).alias("comparable"))
