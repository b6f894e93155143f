"""Connected components by alternating large-star and small-star rounds.

Each round is two hash aggregations and two joins, and the number of rounds is
logarithmic in practice.  No link or label reaches the driver, only one count
and one checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of the nodes 0 to n - 1 to the first node of its part: the same components with few links."""
    label = np.arange(n)
    for x, y in pairs:
        while True:
            low = np.minimum(label[x], label[y])
            if (low == label[x]).all() and (low == label[y]).all():
                break
            for side in (x, y):
                np.minimum.at(label, label[side], low)
                np.minimum.at(label, side, low)
            label = label[label]
    while (label != label[label]).any():
        label = label[label]
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def _stamp(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b) links, either way round -> (node, root), root the least node.

    Only nodes that have a link to another node appear.  No links: no rows.
    Repeated and self links do no harm.
    """
    edges = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _stamp(edges)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = cut(small)
        after = _stamp(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
