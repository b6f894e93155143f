"""Collections: what they are, which exist, and which one a file belongs to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Collection:
    id: str
    label: str = ""
    language: str = "he"  # he or en
    citation: str = "instruction"  # instruction or page
    members: tuple[str, ...] = field(default=())


class Registry:
    """Declared collections; an unknown id resolves to the first one."""

    def __init__(self, collections: list[Collection]) -> None:
        if not collections:
            raise ValueError("at least one collection is needed")
        self.all = list(collections)
        self._by_id = {c.id: c for c in reversed(collections)}

    def get(self, name: str) -> Collection:
        return self._by_id.get(name, self.all[0])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.id, c.label, c.language, c.citation, list(c.members)) for c in self.all]
        return spark.createDataFrame(rows, "id string, label string, language string, citation string, members array<string>")


def present_members(collections: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, member) of declared members that have an index; indexed: (collection)."""
    declared = collections.select("id", F.explode("members").alias("member"))
    return declared.join(indexed.select(F.col("collection").alias("member")).distinct(), "member", "left_semi").select("id", "member")


def coverage(collections: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, searched, declared, missing): how many members are searched, and which are not there."""
    declared = collections.select("id", F.explode_outer("members").alias("member"))
    there = indexed.select(F.col("collection").alias("member")).distinct().withColumn("there", F.lit(1))
    joined = declared.join(there, "member", "left")
    return joined.groupBy("id").agg(
        F.greatest(F.lit(1), F.count("there")).cast("long").alias("searched"),
        F.greatest(F.lit(1), F.count("member")).cast("long").alias("declared"),
        F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("member")))).alias("missing"),
    )


def available(collections: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id) of what can be offered: an index of its own, or two members that have one."""
    there = indexed.select("collection").distinct()
    own = collections.filter(F.size("members") == 0).join(there, collections["id"] == there["collection"], "left_semi").select("id")
    joined = present_members(collections, indexed).groupBy("id").agg(F.count("*").alias("n")).filter("n >= 2").select("id")
    return own.unionByName(joined)


def oldest_index(metas: DataFrame, members: DataFrame) -> DataFrame:
    """(id, indexed_at): the oldest of each virtual collection's member indexes."""
    return members.join(metas.select(F.col("collection").alias("member"), "indexed_at"), "member").groupBy("id").agg(F.min("indexed_at").alias("indexed_at"))


def collection_of(key: Column, chapters: list[str], prefix: str = "docs/", chapter_prefix: str = "chapter-", default: str = "default") -> Column:
    """Collection of a stored file: its folder below the prefix, else its chapter number, else the default."""
    folder = F.regexp_extract(key, f"^{prefix}([^/]+)/", 1)
    chapter = F.regexp_extract(key, r"(?:^|/)H\.([0-9]+)\.", 1)
    return (
        F.when(folder != "", folder)
        .when((chapter != "") & chapter.isin(chapters), F.concat(F.lit(chapter_prefix), chapter))
        .otherwise(F.lit(default))
    )


def decode_key(key: Column) -> Column:
    """An event's object key: plus signs are blanks, then percent escapes."""
    return F.url_decode(key)
