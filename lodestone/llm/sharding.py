"""Balanced shards by minimax contiguous partition, with DataFrame functions only.

Rows with equal texts form an atomic group.  Groups are ordered by the digest
of their text; the smallest shard capacity for which a greedy walk over the
ordered group sizes needs no more than the wanted number of shards is found by
binary search, and the shards are cut there.

The walk runs on sums by digest prefix: the driver holds at most a few thousand
of them, and asks for the next two digits only of prefixes in which a cut may
fall.  A cut is a digest, so that a row's shard needs no join.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

FIRST_DIGITS = 3
MORE_DIGITS = 2


class _Sizes:
    """Group sizes in digest order, known by prefix and only as finely as was needed."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups
        self.total, self.largest = 0, 0
        top = groups.agg(F.sum("bytes").alias("t"), F.max("bytes").alias("m")).first()
        self.total, self.largest = int(top["t"] or 0), int(top["m"] or 0)
        self.nodes = self._sums(groups, FIRST_DIGITS)
        self._index()

    @staticmethod
    def _sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        rows = (
            groups.groupBy(F.substring("digest", 1, digits).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
            .collect()  # at most 16 ** digits rows, or 256 for each refined prefix
        )
        return sorted((r["prefix"], int(r["bytes"]), int(r["n"])) for r in rows)

    def _index(self) -> None:
        self.nodes.sort()
        self.ends = list(accumulate(b for _, b, _ in self.nodes))

    def refine(self, places: set[int]) -> None:
        by_length: dict[int, list[str]] = {}
        for p in places:
            by_length.setdefault(len(self.nodes[p][0]), []).append(self.nodes[p][0])
        rest = [n for i, n in enumerate(self.nodes) if i not in places]
        for length, prefixes in by_length.items():
            part = self.groups.filter(F.substring("digest", 1, length).isin(prefixes))
            rest += self._sums(part, length + MORE_DIGITS)
        self.nodes = rest
        self._index()

    def walk(self, capacity: int, shards: int) -> tuple[int, int, set[int], list[int]]:
        """Furthest end of a greedy walk as known (at least, at most), the prefixes that leave it open, and the cuts."""
        least = most = 0
        unclear: set[int] = set()
        cuts = []
        for _ in range(shards):
            i = bisect_right(self.ends, least + capacity)
            j = bisect_right(self.ends, most + capacity)
            low = self.ends[i - 1] if i else 0
            high = self.ends[j - 1] if j else 0
            if i < len(self.nodes) and self.nodes[i][2] > 1 and low < least + capacity:
                unclear.add(i)
            if j < len(self.nodes) and self.nodes[j][2] > 1 and high < most + capacity:
                unclear.add(j)
                high = min(most + capacity, self.ends[j] - 1)
            least, most = low, high
            cuts.append(i)
        return least, most, unclear, cuts

    def fits(self, capacity: int, shards: int) -> bool:
        while True:
            least, most, unclear, _ = self.walk(capacity, shards)
            if least >= self.total:
                return True
            if most < self.total:
                return False
            self.refine(unclear)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(digest, bytes) groups -> (smallest capacity, digest prefix at which each shard but the first begins)."""
    sizes = _Sizes(groups)
    if not sizes.total:
        return 0, []
    low = max(-(-sizes.total // shards), sizes.largest)
    high = -(-sizes.total // shards) + sizes.largest  # a walk of this capacity always fits
    while low < high:
        middle = (low + high) // 2
        if sizes.fits(middle, shards):
            high = middle
        else:
            low = middle + 1
    while True:
        _, _, unclear, cuts = sizes.walk(low, shards)
        if not unclear:
            return low, [sizes.nodes[i][0] for i in cuts if i < len(sizes.nodes)]
        sizes.refine(unclear)


def _shard_of(cuts: list[str]) -> Column:
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("digest") >= F.lit(c)).cast("int")
    return shard


def shard_documents(docs: DataFrame, shards: int = 16, bucket_rows: int = 100_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size is the text's UTF-8 bytes plus 1, null texts count as empty.  Equal
    texts stay together, so one group larger than the rest fills a shard of its
    own.  slot counts from 0 without gaps in each shard: rows are numbered as
    they are read, the numbers deal a shard's rows into buckets of about
    ``bucket_rows``, and a bucket's rows follow those of the buckets before it.
    So null and repeated ids spread like any other.  Repeated rows each get a
    slot; a null doc_id stays null; no rows in, no rows out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
            F.monotonically_increasing_id().alias("number"),
        )
    )
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    _, cuts = minimax_cuts(groups, shards)
    buckets = max(64, -(-rows.count() // bucket_rows))
    placed = rows.withColumn("shard", _shard_of(cuts)).withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("number")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "bucket"])  # dealt by these columns already
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
