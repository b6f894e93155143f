"""Hybrid retrieval for many queries at once.

Hits are rows keyed by ``query_id``; ``pos`` is their place in the query's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Settings
from lodestone.functions.text import PHRASE_BREAK, codes_in, is_tabular, question_phrases
from lodestone.operators.dense import dense_topk, pair_scores
from lodestone.operators.lexical import bm25, chunk_words, rrf

#: Stands where parts of a long document were left out (a fixed value).
GAP = "[…קטעים מההוראה הושמטו כאן — ההוראה ארוכה מכדי להיכלל במלואה…]"


# Ranking ----------------------------------------------------------------------


def diversify(hits: DataFrame, k: int, cap: int, doc: list[str], order: list[Column]) -> DataFrame:
    """At most ``cap`` rows per document, filled up to ``k`` with what is left, in the given order."""
    own = Window.partitionBy("query_id", *doc).orderBy(*order)
    capped = hits.withColumn("_n", F.row_number().over(own))
    first = Window.partitionBy("query_id").orderBy(F.col("_n") > cap, *order)
    return capped.withColumn("_p", F.row_number().over(first)).filter(F.col("_p") <= k).drop("_n", "_p")


def confident(hits: DataFrame, threshold: Column) -> DataFrame:
    """(query_id, best, confident): a named document, or a best non-lexical score at the threshold or above."""
    semantic = F.when(~F.coalesce("lexical", F.lit(False)), F.col("score"))
    return hits.groupBy("query_id").agg(
        F.max(semantic).alias("best"),
        (F.coalesce(F.bool_or("named"), F.lit(False)) | (F.coalesce(F.max(semantic), F.lit(-2.0)) >= F.max(threshold))).alias("confident"),
    )


def named_codes(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, code) for every code that a question names and that exists."""
    asked = queries.select("query_id", F.explode(codes_in(F.col("text"))).alias("code")).distinct()
    return asked.join(chunks.select("code").distinct(), "code", "left_semi")


def rare_phrases(queries: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, phrase): word pairs of the question that few documents with tables hold.

    Of the tables only the distinct word pairs of each document are kept,
    before anything is joined, so that no row meets a phrase.
    """
    asked = queries.select("query_id", F.explode(question_phrases(F.col("text"))).alias("phrase")).distinct()
    tables = chunks.filter(is_tabular(F.col("text")))
    pairs = _word_pairs(tables, ["code"]).distinct()
    matched = pairs.join(_matches(asked.select("phrase").distinct(), pairs), ["left", "right"]).select("phrase", "code").distinct()
    rare = matched.groupBy("phrase").agg(F.count("code").alias("docs")).filter(F.col("docs") <= settings.table_phrase_max_docs)
    return asked.join(rare.select("phrase"), "phrase")


def _word_pairs(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right): what stands before and behind each blank, up to a character that no phrase has; short ones can't hold a phrase's word."""
    words = F.split("text", " ")
    last = F.greatest(F.size(words) - 1, F.lit(0))
    ends = F.zip_with(
        F.slice(words, 1, last), F.slice(words, 2, last),
        lambda a, b: F.struct(F.regexp_replace(a, rf"(?s)^.*{PHRASE_BREAK}", "").alias("left"), F.regexp_replace(b, rf"(?s){PHRASE_BREAK}.*", "").alias("right")),
    )
    rows = tables.select(*keys, F.explode(F.array_distinct(ends)).alias("pair")).select(*keys, "pair.left", "pair.right")
    return rows.filter((F.length("left") >= 3) & (F.length("right") >= 3))


def _matches(phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(phrase, left, right) where a text that has the pair holds the phrase.

    Distinct pairs and phrases meet by the phrase's middle: the end of its
    first word, a blank and the start of its second.
    """
    keyed = phrases.withColumn("key", F.regexp_extract("phrase", r"(\S{3} \S{3})", 1))
    distinct = pairs.select("left", "right").distinct()
    met = distinct.withColumn("key", F.concat_ws(" ", F.substring("left", -3, 3), F.substring("right", 1, 3))).join(keyed, "key")
    first, second = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    return met.filter(F.endswith("left", first) & F.startswith("right", second)).select("phrase", "left", "right")


def _holding(phrases: DataFrame, tables: DataFrame) -> DataFrame:
    """(phrase, ord) where the row's text contains the phrase; no text is shuffled."""
    pairs = _word_pairs(tables, ["ord"])
    return pairs.join(_matches(phrases, pairs), ["left", "right"]).select("phrase", "ord").distinct()


def table_assist(queries: DataFrame, chunks: DataFrame, picked: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, ord, score): tables that hold a rare phrase and weren't picked, best first, a few."""
    phrases = rare_phrases(queries.select("query_id", "text"), chunks, settings)
    tables = chunks.filter(is_tabular(F.col("text")))
    held = _holding(phrases.select("phrase").distinct(), tables).join(phrases, "phrase").select("query_id", "ord").distinct()
    spare = held.join(picked.select("query_id", "ord"), ["query_id", "ord"], "left_anti")
    extra = pair_scores(spare, chunks, queries).filter(F.col("score").isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return extra.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= settings.table_assist_max).select("query_id", "ord", "score", F.col("_p").alias("extra"))


# Hybrid search -------------------------------------------------------------------


def fuse(queries: DataFrame, chunks: DataFrame, semantic: DataFrame, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, ord, score, lexical, named, fused_rank) from dense, lexical and named lists.

    queries: (query_id, variant, text, vector); semantic: (query_id, ord,
    score, rank), the best k dense hits.  Each list is cut before fusion and the
    lists may overlap; what the other lists find beyond the dense list is scored
    pair by pair, and lexical hits without a vector are flagged.
    """
    variants = queries.withColumn("qv", F.concat_ws("\0", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    ranked = bm25(chunks, chunk_words(settings), variants.select(F.col("qv").alias("query_id"), "text"), settings.hybrid_candidates, settings=settings)
    words = ranked.withColumnRenamed("query_id", "qv").join(variants.select("qv", "query_id", "variant"), "qv")
    once = words.groupBy("query_id", "ord").agg(F.min(F.struct("variant", "rank")).alias("at"))
    lexical = once.select(
        "query_id", "ord", F.lit(2).alias("list"), F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("pos")
    )
    exact = _exact(queries, chunks, settings)
    dense = semantic.filter(F.col("rank") <= k).select("query_id", "ord", F.lit(1).alias("list"), F.col("rank").alias("pos"))
    fused = rrf(dense.unionByName(lexical).unionByName(exact.select("query_id", "ord", "list", "pos")), ["ord"], settings.rrf_k)
    fused = fused.filter(F.col("rank") <= k).select("query_id", "ord", (F.col("rank") - 1).alias("fused_rank"))
    named = exact.select("query_id", "ord", F.lit(True).alias("named")).distinct()
    known = pair_scores(fused.select("query_id", "ord"), chunks, queries)
    return (
        fused.join(known, ["query_id", "ord"], "left")
        .join(named, ["query_id", "ord"], "left")
        .select(
            "query_id",
            "ord",
            F.coalesce("score", F.lit(0.0)).alias("score"),
            (F.col("score").isNull() & F.col("named").isNull()).alias("lexical"),
            F.coalesce("named", F.lit(False)).alias("named"),
            "fused_rank",
        )
    )


def _exact(queries: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """First chunks of the documents that a question names, as the third list; documents in the order of the corpus."""
    named = named_codes(queries, chunks)
    own = Window.partitionBy("query_id", "code").orderBy("index", "ord")
    heads = chunks.select("code", "index", "ord").join(named, "code")
    heads = heads.withColumn("_first", F.min("ord").over(Window.partitionBy("query_id", "code")))
    heads = heads.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= settings.named_code_chunks)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "_n"))
    return heads.select("query_id", "ord", F.lit(3).alias("list"), pos.alias("pos"))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Hits of each query over one vector space: dense, fused, diversified, with table rows appended.

    queries: (query_id, variant, text, vector); chunks: the chunk columns with
    ``ord``, their place in the corpus.
    """
    k = k or settings.top_k
    pool = max(k * 4, 20)
    semantic = dense_topk(chunks, queries, pool)
    if settings.hybrid_search:
        ranked = fuse(queries, chunks, semantic, pool, settings)
    else:
        ranked = semantic.select("query_id", "ord", "score", F.lit(False).alias("lexical"), F.lit(False).alias("named"), F.col("rank").alias("fused_rank"))
    doc = chunks.select("ord", "collection", "code")
    picked = diversify(ranked.join(doc, "ord"), k, settings.max_per_doc, ["collection", "code"], [F.col("fused_rank"), F.col("ord")])
    hits = picked.select("query_id", "ord", "score", "lexical", "named", "fused_rank", F.lit(0).alias("extra"))
    if settings.table_assist:
        extra = table_assist(queries, chunks, picked, settings)
        hits = hits.unionByName(
            extra.select("query_id", "ord", "score", F.lit(True).alias("lexical"), F.lit(False).alias("named"), F.lit(None).cast("int").alias("fused_rank"), "extra")
        )
    return _placed(hits, [F.col("extra"), F.col("fused_rank"), F.desc("score"), F.col("ord")], chunks).drop("extra")


def _placed(hits: DataFrame, order: list[Column], chunks: DataFrame) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    detail = chunks.select("ord", "collection", "id", "code", "title", "index", "text", "keywords", "doctype", "source_url")
    return hits.withColumn("pos", pos).join(detail, "ord")


def retrieve_union(queries: DataFrame, chunks: DataFrame, k: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Several collections of one vector space as one corpus: a larger pool, named documents first."""
    k = k or settings.top_k
    pool = max(k * 6, 30)
    fused = fuse(queries, chunks, dense_topk(chunks, queries, pool), pool, settings)
    first = Window.partitionBy("query_id").orderBy(~F.col("named"), "fused_rank")
    ordered = fused.withColumn("fused_rank", F.row_number().over(first) - 1)
    picked = diversify(ordered.join(chunks.select("ord", "collection", "code"), "ord"), k, settings.max_per_doc, ["collection", "code"], [F.col("fused_rank")])
    hits = picked.select("query_id", "ord", "score", "lexical", "named", "fused_rank", F.lit(0).alias("extra"))
    if settings.table_assist:
        extra = table_assist(queries, chunks, picked, settings)
        hits = hits.unionByName(
            extra.select("query_id", "ord", "score", F.lit(True).alias("lexical"), F.lit(False).alias("named"), F.lit(None).cast("int").alias("fused_rank"), "extra")
        )
    return _placed(hits, [F.col("extra"), F.col("fused_rank"), F.col("ord")], chunks).drop("extra")


def merge_collections(hits: DataFrame, k: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Hits of separate collections as one list: named first by rank, the rest by score, then a few lexical ones."""
    k = k or settings.top_k
    semantic = hits.filter(~F.col("lexical"))
    order = Window.partitionBy("query_id").orderBy(~F.col("named"), F.when(F.col("named"), F.col("fused_rank")), F.desc("score"), "collection", "ord")
    ranked = semantic.withColumn("_at", F.row_number().over(order))
    picked = diversify(ranked, k, settings.max_per_doc, ["collection", "code"], [F.col("_at")])
    keys = ["query_id", "collection", "id"]
    spare = hits.filter("lexical").join(picked.select(*keys), keys, "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "collection", "ord")
    spare = spare.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= settings.table_assist_max)
    both = picked.select(*hits.columns, F.lit(0).alias("_l"), F.col("_at")).unionByName(spare.select(*hits.columns, F.lit(1).alias("_l"), F.col("_n").alias("_at")))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("_l", "_at"))
    return both.withColumn("pos", pos).drop("_l", "_at")


def one_space(metas: DataFrame) -> DataFrame:
    """Index rows -> (same_space, collections): whether all collections share model and width."""
    return metas.agg((F.countDistinct("embed_model", "dims") <= 1).alias("same_space"), F.count("*").alias("collections"))


def retrieve_across(queries: DataFrame, chunks: DataFrame, metas: DataFrame, k: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Hits of each query over several collections.

    queries: (query_id, variant, text, vector, embed_transport), one row per
    transport whose vectors are at hand.  Collections that share one transport,
    model and width are searched as one corpus; else each is searched in its own
    space, those without query vectors are left out, and the lists are merged.
    metas: one row per declared collection, a small dimension.
    """
    known = metas.select("collection", "embed_transport", "embed_model", "dims").collect()
    spaces = {(m["embed_transport"], m["embed_model"], m["dims"]) for m in known}
    columns = ["query_id", "variant", "text", "vector"]
    if settings.hybrid_search and len(known) > 1 and len(spaces) == 1 and known[0]["embed_transport"]:
        own = queries.filter(F.col("embed_transport") == known[0]["embed_transport"]).select(*columns)
        return retrieve_union(own, chunks, k, settings)
    parts = None
    for m in known:
        own = queries.filter((F.col("embed_transport") == m["embed_transport"]) & (F.size("vector") == m["dims"])).select(*columns)
        part = retrieve(own, chunks.filter(F.col("collection") == m["collection"]), k, settings)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("none of the wanted collections has an index")
    return merge_collections(parts, k, settings)


# Documents ---------------------------------------------------------------------------


def chunks_per_doc(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection", "code").agg(F.count("*").alias("total"))


def parent_vote(hits: DataFrame, totals: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Documents many of whose chunks were found move up, as their best chunk.

    hits: (query_id, pos, collection, code, id, score, lexical, named).  Adds
    ``merged`` (ids that a row stands for) and ``parent_votes``; ``pos`` is the
    new place.  A query where nothing qualifies keeps its list.
    """
    k = settings.parent_vote_k
    group = Window.partitionBy("query_id", "_kind", "collection", "code")
    kind = F.when(F.col("lexical"), 2).when(F.col("named"), 0).otherwise(1)
    at = F.row_number().over(Window.partitionBy("query_id", "_kind").orderBy("pos"))
    rows = hits.withColumn("_kind", kind).withColumn("_at", at)
    rows = rows.join(totals, ["collection", "code"], "left")
    rows = rows.withColumn("_votes", F.count("*").over(group)).withColumn("_total", F.coalesce("total", "_votes"))
    enough = (
        (F.col("_kind") == 1)
        & (F.col("_votes") >= max(2, settings.parent_vote_min_chunks))
        & (F.col("_total") >= settings.parent_vote_min_total)
        & (F.col("_votes") / F.col("_total") >= settings.parent_vote_ratio)
    )
    best = F.row_number().over(group.orderBy(F.desc("score"), "_at"))
    own = 1.0 / (k + F.col("_at"))
    rows = (
        rows.withColumn("_ok", enough)
        .withColumn("_applied", F.max("_ok").over(Window.partitionBy("query_id")))
        .withColumn("_best", best)
        .withColumn("_joint", F.when(F.col("_ok"), F.sum(own).over(group)).otherwise(own))
        .withColumn("_first", F.when(F.col("_ok"), F.min("_at").over(group)).otherwise(F.col("_at")))
        .withColumn("merged", F.when(F.col("_ok"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "id")).over(group)), lambda x: x["id"])))
        .withColumn("parent_votes", F.when(F.col("_ok"), F.col("_votes")))
        .filter(~F.col("_ok") | (F.col("_best") == 1))
    )
    moved = F.row_number().over(Window.partitionBy("query_id").orderBy("_kind", F.when(F.col("_kind") == 1, -F.round("_joint", 12)), "_first"))
    place = F.when(F.col("_applied"), moved).otherwise(F.col("pos"))
    return rows.withColumn("_place", place).select(*[c for c in hits.columns if c != "pos"], F.col("_place").cast("int").alias("pos"), "merged", "parent_votes", F.col("_applied").alias("applied"))


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = DEFAULT.neighbour_radius) -> DataFrame:
    """Hits with the chunks next to them, by document in order of its first hit and then by index."""
    keys = ["query_id", "collection", "code"]
    doc_pos = hits.groupBy(*keys).agg(F.min("pos").alias("doc_pos"))
    wanted = hits.select(*keys, F.explode(F.sequence(F.col("index") - radius, F.col("index") + radius)).alias("index")).distinct()
    score = hits.groupBy(*keys, "index").agg(F.max("score").alias("score"))
    found = chunks.select("collection", "code", "index", "id", "text").join(wanted, ["collection", "code", "index"])
    out = found.join(score, [*keys, "index"], "left").join(doc_pos, keys)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_pos", "index"))
    return out.select(*keys, "index", "id", "text", F.coalesce("score", F.lit(0.0)).alias("score"), pos.alias("pos"))


def _budgeted(settings: Settings) -> Column:
    """Fold over ``docs``, a query's documents in order: which parts of each go in, while the budget lasts.

    A document whose size is left in the budget goes in whole; the first may
    pass it by the slack.  Of another, an excerpt may take half of what is left:
    its head, up to 0.6 of that, and the neighbours of what matched, as far as
    they fit; what matched goes in always.
    """
    chars, slack = settings.parent_context_chars, settings.parent_slack
    allowance = F.lit(float(chars) * (1 + slack)) if slack > 0 else F.lit(-1.0)

    def excerpt(doc: Column, cap: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

        def take(acc: Column, part: Column) -> Column:
            near = part["near"] | (part["upto"] <= cap * 0.6)
            fits = part["hit"] | (acc["used"] + part["size"] <= cap)
            grown = F.struct((acc["used"] + part["size"]).alias("used"), F.concat(acc["kept"], F.array(part["at"])).alias("kept"))
            return F.when(near & fits, grown).otherwise(acc)

        return F.aggregate(doc["parts"], start, take)

    def spend(acc: Column, doc: Column) -> Column:
        whole = (doc["size"] <= acc["left"]) | ((doc["rank"] == 1) & (doc["size"] <= allowance))
        part = excerpt(doc, F.floor(acc["left"] * 0.5))
        every = F.struct(doc["size"].alias("used"), F.transform(doc["parts"], lambda x: x["at"]).alias("kept"))
        taken = F.when(whole, every).otherwise(part)
        left = F.when(whole, F.greatest(F.lit(0).cast("long"), acc["left"] - doc["size"])).otherwise(acc["left"] - taken["used"])
        told = F.struct(doc["rank"].alias("rank"), whole.alias("whole"), taken["kept"].alias("kept"))
        return F.struct(left.alias("left"), F.concat(acc["out"], F.array(told)).alias("out"))

    nothing = F.array().cast("array<struct<rank:int,whole:boolean,kept:array<int>>>")
    return F.aggregate("docs", F.struct(F.lit(chars).cast("long").alias("left"), nothing.alias("out")), spend, lambda acc: acc["out"])


def parent_context(hits: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Passages of each query: whole documents while the budget lasts, excerpts of longer ones, then what is left.

    Places and sizes of the chunks are enough to decide (a query hits a few
    documents, so its row is small); texts are joined to what goes in.
    Excerpts mark their gaps.
    """
    radius = max(1, settings.neighbour_radius)
    doc, key = ["query_id", "collection", "code"], ["query_id", "collection", "id"]
    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns])  # noqa: E731  hits and chunks may come from one frame
    own = fresh(hits)
    stands_for = F.coalesce(F.when(F.size("merged") > 0, F.col("merged")), F.array("id")) if "merged" in hits.columns else F.array("id")
    found = own.groupBy(*doc).agg(F.min(F.when(~F.col("lexical"), F.col("pos"))).alias("first"), F.flatten(F.collect_list(stands_for)).alias("ids"))
    found = found.filter(F.col("first").isNotNull())
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))

    sized = fresh(chunks.select("collection", "code", "id", "index", F.length("text").cast("long").alias("size")))
    parts = found.join(sized, ["collection", "code"])
    order = Window.partitionBy(*doc).orderBy("index", "id")
    parts = parts.withColumn("at", F.row_number().over(order) - 1).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("hit", F.array_contains("ids", F.col("id")))
    parts = parts.withColumn("near", F.max("hit").over(order.rowsBetween(-radius, radius))).withColumn("parts", F.count("*").over(Window.partitionBy(*doc)))

    listed = parts.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "size", "upto", "hit", "near"))).alias("parts"), F.sum("size").alias("size"))
    docs = listed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "size", "parts"))).alias("docs"))
    taken = docs.select("query_id", F.explode(_budgeted(settings)).alias("d")).select("query_id", "d.rank", "d.whole", F.explode("d.kept").alias("at"))

    placed = taken.join(parts.select("query_id", "rank", "at", "collection", "code", "id", "index", "parts"), ["query_id", "rank", "at"])
    score = own.groupBy(*key).agg(F.max("score").alias("score"))
    texts = fresh(chunks.select("collection", "id", "title", "text"))
    placed = placed.join(texts, ["collection", "id"]).join(score, key, "left")
    along = Window.partitionBy("query_id", "rank").orderBy("at")
    before = F.coalesce(F.lag("at").over(along), F.lit(-1))
    gap_before = F.when(~F.col("whole") & (F.col("at") != before + 1), F.lit(f"{GAP}\n")).otherwise("")
    gap_behind = F.when(~F.col("whole") & F.lead("at").over(along).isNull() & (F.col("at") < F.col("parts") - 1), F.lit(f"\n{GAP}")).otherwise("")
    shape = ["query_id", "collection", "code", "id", "index", "title"]
    inside = placed.select(*shape, F.concat(gap_before, F.col("text"), gap_behind).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("rank").alias("_a"), F.col("at").alias("_b"))

    rest = own.join(inside.select(*key).distinct(), key, "left_anti")
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).filter("_n = 1")
    rest = rest.select(*shape, "text", "score", F.lit(1 << 30).alias("_a"), F.col("pos").alias("_b"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("_a", "_b"))
    return inside.unionByName(rest).withColumn("pos", pos).select("query_id", "pos", "collection", "code", "id", "index", "title", "text", "score")
