"""SimHash near-duplicates, linked by tiled exact comparison.

Distinct fingerprints are compared in tiles with numpy exclusive-or and bit
counts; a pair of tiles whose population counts differ beyond the radius is
skipped.  This is so in every bucket, whatever its size.  Which rows meet in a tile is decided by agreeing bits: the 64 bits
are cut into ``radius + 2`` blocks, so two fingerprints within the radius
agree in at least two whole blocks and meet under that pair of blocks.  The
comparison is exact, and its cost grows with the bucket sizes instead of with
the square of the corpus.

A bucket above ``tile_rows`` rows is split by the bits of the blocks that it
doesn't name, and dealt by population count and hash only if that isn't enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shingles
from lodestone.llm.common import byte_texts, cut, id_and_text, keep_representatives, map_batches, same_text
from lodestone.llm.components import connected_components, spanning
from lodestone.llm.shingles import majority, runs

TILE = 512


def fingerprint(data: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of a UTF-8 text, unsigned; no words: 0."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles: Iterator[bytes] = iter([b" ".join(tokens)])
        count = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        count = len(tokens) - words + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=count))


def fingerprints(docs: DataFrame, words: int = 3, with_text_mark: bool = False) -> DataFrame:
    """(doc_id, fp[, same]): one row per document, fp the fingerprint as a signed long, same the mark of its text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, words) for x in byte_texts(batch)], dtype=np.uint64).view(np.int64)
        marks = [batch.column(2)] if with_text_mark else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *marks], names=["doc_id", "fp", "same"][: 2 + len(marks)])

    named = id_and_text(docs)
    if with_text_mark:
        return map_batches(named.withColumn("same", same_text(F.col("text"))), make, "doc_id long, fp long, same string")
    return map_batches(named, make, "doc_id long, fp long")


def close_pairs(fp: np.ndarray, bucket: np.ndarray, radius: int, side: np.ndarray | None = None, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius and of one bucket, tile pair by tile pair.

    ``bucket`` is sorted.  Rows are ordered by bucket and population count and
    cut into tiles; two tiles are compared if they have a bucket in common and
    population counts there that differ by no more than the radius.  With
    ``side``, only rows of different sides make a pair.
    """
    counts = np.bitwise_count(fp)
    order = np.lexsort((counts, bucket))
    f, g, c = fp[order], bucket[order], counts[order]
    s = None if side is None else side[order]
    for i in range(0, len(f), tile):
        last = min(i + tile, len(f)) - 1
        a = slice(i, last + 1)
        for j in range(i, len(f), tile):
            if j > i and (g[j] != g[last] or int(c[j]) - int(c[last]) > radius):
                break  # later tiles have later buckets, or larger counts of this one
            b = slice(j, min(j + tile, len(f)))
            near = (np.bitwise_count(f[a, None] ^ f[None, b]) <= radius) & (g[a, None] == g[None, b])
            if s is not None:
                near &= s[a, None] != s[None, b]
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                yield order[i + x], order[j + y]


def _link_groups(radius: int):
    """mapInArrow body over rows (g1, g2, g3, g4, side, fp) sorted by the group columns; side is -1 where a bucket has none."""

    def link(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for own in (side < 0, side >= 0):
            if own.any():
                sides = side[own] if side[own][0] >= 0 else None
                a, b = (fp[own][at] for at in spanning(own.sum(), close_pairs(fp[own], bucket[own], radius, sides)))
                if len(a):
                    yield _links(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = [np.concatenate([k, c]) for k, c in zip(kept, columns)] if kept else columns
            ids = runs(kept[:4])
            last = np.searchsorted(ids, ids[-1])
            if last:
                yield from link(ids[:last], kept[4][:last], kept[5][:last].view(np.uint64))
                kept = [k[last:] for k in kept]
        if kept:
            yield from link(runs(kept[:4]), kept[4], kept[5].view(np.uint64))

    return run


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _blocks(radius: int) -> list[tuple[Column, int]]:
    """The bits of each of ``radius + 2`` blocks, with the block's width."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), hi - lo) for lo, hi in zip(edges, edges[1:])]


def _block_keys(radius: int) -> list[Column]:
    """One key per pair of blocks: the pair's number above the bits of both blocks."""
    pairs = enumerate(combinations(_blocks(radius), 2))
    return [(F.shiftleft(a, width) + b).bitwiseOR(F.lit(n << 56)) for n, ((a, _), (b, width)) in pairs]


def _finer_keys(radius: int) -> Column:
    """Keys that split the bucket of a pair of blocks by the bits of the others.

    ``radius`` blocks are left.  Two fingerprints within the radius either agree
    in one of them, or differ by one bit in each: then they agree in the first
    one with that bit left out.
    """
    own = None
    for n, pair in enumerate(combinations(range(radius + 2), 2)):
        rest = [x for i, x in enumerate(_blocks(radius)) if i not in pair]
        tagged = [part.bitwiseOR(F.lit((i + 1) << 40)) for i, (part, _) in enumerate(rest)]
        first, width = rest[0]
        tagged += [first.bitwiseAND(F.lit(~(1 << k))).bitwiseOR(F.lit((radius + 1 + k) << 40)) for k in range(width)]
        chosen = F.shiftrightunsigned("key", 56) == n
        own = F.when(chosen, F.array(*tagged)) if own is None else own.when(chosen, F.array(*tagged))
    return own


def near_links(prints: DataFrame, radius: int = 3, tile_rows: int = 16384) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join all pairs within the radius.

    A bucket above ``tile_rows`` rows is split by the bits of the remaining
    blocks; what is still above it then, by population count and hash, into
    pairs of tiles.
    """
    none = F.lit(0).cast("long")
    keyed = prints.select("fp", F.explode(F.array(*_block_keys(radius))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(shared, "key")
    whole = met.filter(F.col("n") <= tile_rows).select(F.col("key").alias("g1"), none.alias("g2"), none.alias("g3"), none.alias("g4"), F.lit(-1).alias("side"), "fp")
    finer = met.filter(F.col("n") > tile_rows).select("key", "fp", F.explode(_finer_keys(radius)).alias("sub"))
    many = finer.groupBy("key", "sub").agg(F.count("*").alias("n")).filter("n > 1")
    finer = finer.join(many, ["key", "sub"])
    split = finer.filter(F.col("n") <= tile_rows).select(
        F.col("key").alias("g1"), F.col("sub").alias("g2"), none.alias("g3"), none.alias("g4"), F.lit(-1).alias("side"), "fp"
    )
    number = lambda count, part: count.cast("long") * F.lit(1 << 20) + part
    tiles = F.ceil(F.col("n") / tile_rows).cast("int")
    own = number(F.bit_count("fp"), F.pmod(F.xxhash64("fp"), F.col("tiles")))
    others = F.flatten(
        F.transform(
            F.sequence(F.greatest(F.lit(0), F.bit_count("fp") - radius), F.least(F.lit(64), F.bit_count("fp") + radius)),
            lambda p: F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: number(p, t)),
        )
    )
    large = finer.filter(F.col("n") > tile_rows).withColumn("tiles", tiles).select("key", "sub", "fp", own.alias("own"), F.explode(others).alias("other"))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    spread = large.select(F.col("key").alias("g1"), F.col("sub").alias("g2"), F.least("own", "other").alias("g3"), F.greatest("own", "other").alias("g4"), side.alias("side"), "fp")
    groups = ["g1", "g2", "g3", "g4"]
    dealt = whole.unionByName(split).unionByName(spread).repartition(*groups).sortWithinPartitions(*groups)
    return dealt.mapInArrow(_link_groups(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, the document's own included.  Null and empty
    texts have fingerprint 0 and are linked like any other; a null doc_id gets
    the component of its fingerprint (null if that has no other id).  Repeated
    rows come back repeated.  No rows in: no rows out.
    """
    ids = cut(fingerprints(docs, words))
    prints = cut(ids.groupBy("fp").agg(F.min("doc_id").alias("least")))
    placed = _rooted(prints, radius)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(named, "root").select("fp", "component_id")
    return ids.join(of_print, "fp").select("doc_id", "fp", "component_id")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints with ``root``, the mark of their component."""
    roots = connected_components(near_links(prints.select("fp"), radius))
    return prints.join(roots, prints["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """One row of each group of near duplicates, by fingerprints within the radius; all columns stay.

    Rows are judged by their texts: see ``common.keep_representatives``.  For
    groups by similarity of five-word shingles see ``keep_similar``.
    """
    ids = cut(fingerprints(docs, words, with_text_mark=True))
    rooted = _rooted(cut(ids.select("fp").distinct()), radius)
    return keep_representatives(docs, ids.join(rooted, "fp").select("doc_id", "same", "root"))


def keep_similar(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, by five-word similarity of 0.8 or more; all columns stay.

    SimHash fingerprints of the five-word shingles are linked at 3 bits as
    everywhere here: rows meet where two of five bit blocks agree, and are
    compared in tiles by exclusive-or and bit counts.  Texts that similar often
    differ in ten bits, a radius at which no blocks agree often enough to be
    dealt by.  So ``shingles`` adds the candidates of an exact prefix join,
    tiled in the same way, and verifies all on the sets.  No link is lost.
    """
    return shingles.keep_one(docs, near_links)
