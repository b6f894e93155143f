"""Quality classifier: an additive model with pairwise interactions over text statistics.

The model is fitted on a bounded sample of labelled rows (``max_train``, the
rows with the smallest hash of doc_id) and every document is scored in one
pass over its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_texts, id_and_text, map_batches, sparing
from lodestone.llm.gam import PairwiseGam

MAX_TRAIN = 20_000
CUTOFF = 0.3
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
OTHER = b"!?.,;:()[]{}\"'=+-_/\\@"
FEATURES = (
    "words", "word_length", "distinct_words", "top_word", "distinct_pairs", "adjacent_repeats",
    "upper", "digits", "non_ascii", "exclamations", "symbols", "pipes", "other_marks",
    "lines", "line_length", "repeated_lines", "ends",
)


def features(data: bytes) -> list[float]:
    """Statistics of a whole text; an empty one is all zeros."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(data)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = sum(map(data.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    plain = data.translate(None, UPPER)
    high = size - len(data.translate(None, bytes(range(128, 256))))
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        sum(map(eq, words, words[1:])) / n,
        (size - len(plain)) / size,
        (size - len(data.translate(None, DIGITS))) / size,
        high / size,
        data.count(b"!") / n,
        symbols / n,
        data.count(b"|") / n,
        (size - len(data.translate(None, OTHER))) / n,
        float(np.log1p(len(lines))),
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        data.count(b".") / n,
    ]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(x) for x in byte_texts(batch)], dtype=float).reshape(-1, len(FEATURES))


def in_training(column: str = "doc_id"):
    """crc32 of the id's text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> PairwiseGam:
    """Model from at most ``max_train`` labelled rows outside the held-out fifth.

    Null labels are left out; an id labelled both ways counts as 0; of documents
    that share an id the one with the least features is taken; no labels or one
    class gives a constant score.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & in_training())
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    chosen = id_and_text(docs).join(F.broadcast(marked), "doc_id").select("doc_id", "y", "text")  # at most max_train small rows

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # One row for each id, however often it occurs: at most max_train reach the driver.
    known = map_batches(chosen, make, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r"))
    rows = known.select("r.y", "r.x").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("y").to_pylist(), dtype=float)
    order = np.lexsort((*x.T[::-1], y)) if len(y) else np.arange(0)
    return PairwiseGam().fit(x[order], y[order])


def score(docs: DataFrame, model: PairwiseGam) -> DataFrame:
    """(doc_id, score) by row; null and empty texts get a score like any other."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])

    return map_batches(id_and_text(docs), make, "doc_id long, score double")


def keep_good(docs: DataFrame, model: PairwiseGam, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``cutoff``; all columns stay.

    Rows are judged one by one: null and empty texts get a score like any other,
    repeated rows and rows without a doc_id stay or go by their texts.  No rows
    in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_matrix(batch)) >= cutoff))

    return docs.mapInArrow(sparing(run), docs.schema)
