"""Block-maximum index and ranked search that reads only postings that can matter.

Documents are cut into blocks of alike ones: in the order of their most frequent term, so
that a block's largest BM25 part of a term tells something about all of it. A term's postings lie
in one row per block with that maximum beside them. A search works in steps:

1. The maxima alone give each block a bound for a query, their sum over the query's terms.
2. The query's rarest terms, ``FIRST_SHARE`` of its postings, are read. The blocks of the documents with the
   best sums are scored. The k-th best score found is one that the answer's last document reaches.
3. Terms whose maxima add up to less than that cannot make a document an answer by themselves; those with
   the most postings are left out. The others are read, in blocks whose bound reaches the score. That
   gives each document a part of its score, and a better k-th one.
4. Documents whose part, with the maxima of the terms left out in their block, reaches it get
   the postings of those terms, from their blocks only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from corpuslab.operators import retrieve as rt
from corpuslab.operators.index import POSTING_BLOCK, Index
from corpuslab.plans import skew
from corpuslab.plans.buckets import Buckets, together
from corpuslab.plans.ranking import top_k
from corpuslab.plans.skew import fits_broadcast, hot_keys, salted_join

BLOCK_DOCS = 16
# The share of a query's postings read first, and of how many times k documents the blocks are then scored.
FIRST_SHARE = 0.2
FIRST_DOCS = 4
# Postings in a bucket of the block table at most, if there are more of them than shuffle partitions hold.
ROWS_PER_TASK = 4_000_000
# Rows of two numbers that weigh as much as a row of other tables that may be broadcast.
NUMBERS_PER_ROW = 16
# Bounds are sums in another order than scores; both have more digits than this.
MARGIN = 1e-6


@dataclass
class BlockIndex:
    """``lists``: block, term, n, most, postings (array of doc_id, part); one row per term and block, in ``tasks`` buckets by block."""

    lists: DataFrame
    index: Index
    path: str
    tasks: int

    def described(self) -> Buckets:
        """The lists as buckets, until these are closed."""
        return Buckets.over(self.lists, self.path, "block", "blocks", self.tasks)


@dataclass
class Pruned:
    """``hits``: query_id, doc_id, score, rank. ``report``: query_id, postings and maxima of its terms, postings_read."""

    hits: DataFrame
    report: DataFrame


def topic_blocks(index: Index, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, block) of documents with tokens, in the order of (most frequent term, doc_id).

    Places come from counts per term and range of ids, so that no term's documents meet in one task.
    """
    tops = _rows_of(index).select("doc_id", F.array_max(F.transform("counts", lambda c: F.struct(c["tf"], c["term"]))).alias("top"))
    docs = tops.filter("top IS NOT NULL").groupBy("doc_id").agg(F.max("top").alias("top")).select(
        "doc_id", F.col("top.term").alias("topic"), F.floor(F.col("doc_id") / POSTING_BLOCK).alias("piece"))
    docs = rt.written(docs, "document-topics")
    counts = docs.groupBy("topic", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("topic", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("topic", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("topic", "piece").orderBy("doc_id")
    placed = docs.withColumn("place", F.row_number().over(inside)).join(starts, ["topic", "piece"])
    return placed.select("doc_id", F.floor((F.col("start") + F.col("place") - 1) / block_docs).alias("block"))


def _rows_of(index: Index) -> DataFrame:
    """(doc_id, dl, counts) of the documents, as they were counted or put together again from their postings."""
    if index.counted is not None:
        return index.counted.select(F.col("id").alias("doc_id"), "dl", "counts")
    return index.postings.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("counts"))


def build_blocks(index: Index, k1: float = 1.2, b: float = 0.75, block_docs: int = BLOCK_DOCS) -> BlockIndex:
    """Write the block table of an index. A list holds at most ``block_docs`` documents.

    Whole documents travel to their block; only there they become postings, which meet without another shuffle.
    """
    spark = index.postings.sparkSession
    n = index.terms.agg(F.sum("df")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // ROWS_PER_TASK)
    placed = rt.written(topic_blocks(index, block_docs), "document-blocks")
    # two numbers a document
    few = fits_broadcast(placed, NUMBERS_PER_ROW * skew.BROADCAST_ROWS)
    dealt = _rows_of(index).join(F.broadcast(placed) if few else placed, "doc_id").repartition(tasks, "block")
    postings = dealt.select("block", "doc_id", "dl", F.explode("counts").alias("c")).select(
        "block", "doc_id", "dl", F.col("c.term").alias("term"), F.col("c.tf").alias("tf"))

    def lists_of(kept: DataFrame) -> DataFrame:
        parts = kept.groupBy("block", "term", "doc_id").agg(F.sum(rt.bm25_weight(index, k1, b)).alias("part"))
        return parts.groupBy("block", "term").agg(
            F.count(F.lit(1)).alias("n"), F.max("part").alias("most"),
            F.sort_array(F.collect_list(F.struct("doc_id", "part"))).alias("postings"))

    frequent, rare = _by_frequency(index.terms.select("term", "df"))
    with together(spark):
        blocks = Buckets(lists_of(postings.join(F.broadcast(frequent), "term")), "block", "blocks", tasks)
        if rare is not None:
            others = index.postings.join(F.broadcast(frequent.select("term")), "term", "left_anti")
            # terms of few postings each, so no key is hot
            others = others.join(rare, "term").join(placed, "doc_id").repartition(tasks, "block")
            blocks.add(lists_of(others))
    return BlockIndex(blocks.close(), index, blocks.path, tasks)


def _by_frequency(terms: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(term, df) of as many frequent terms as can be broadcast, and of the others, None where there are none."""
    if fits_broadcast(terms):
        return terms, None
    # at most 64 rows: the terms of each power of two
    power = F.floor(F.log2("df"))
    sizes = {r["power"]: r["n"] for r in terms.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, n = 1 + max(sizes, default=0), 0
    while least > 0 and n + sizes.get(least - 1, 0) <= skew.BROADCAST_ROWS:
        least -= 1
        n += sizes.get(least, 0)
    return terms.filter(power >= least), terms.filter(power < least)


def _parts(blocks: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """(query_id, block, doc_id, part) of the postings in ``wanted`` (query_id, term, block)."""
    wanted = wanted.select("query_id", "term", "block")
    # a task holds what it wants of its own blocks, and reads past their lists
    return blocks.select("block", "term", "postings").join(wanted.hint("shuffle_hash") if small else wanted, ["block", "term"]).select(
        "query_id", "block", F.inline("postings"))


DOC_KEY = ["query_id", "block", "doc_id"]


def _sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*DOC_KEY).agg(F.sum("part").alias("part"))


def _added(known: DataFrame, parts: DataFrame, how: str = "full") -> DataFrame:
    """``known`` sums with the sums of further parts; a union would have to be dealt by block again."""
    more = _sums(parts).withColumnRenamed("part", "more")
    return known.join(more, DOC_KEY, how).select(*DOC_KEY, (F.coalesce("part", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("part"))


def search_bm25(queries: DataFrame, blocks: BlockIndex, k: int = rt.BODY_POOL) -> Pruned:
    """The rows of :func:`corpuslab.operators.retrieve.search_bm25`, from the postings that they need.

    A query whose rarest terms give fewer than k documents gets all postings read. Lists stay where their block lies, and so
    do all tables of the search; blocks that are chosen, k best documents and terms of queries travel.
    """
    tables = {"blocks": blocks.described()}
    try:
        with together(queries.sparkSession):
            return _search(queries, blocks, k, tables)
    finally:
        for table in tables.values():
            table.close()


def _search(queries: DataFrame, blocks: BlockIndex, k: int, tables: dict[str, Buckets]) -> Pruned:
    """``tables`` holds the block table and gets those of the search; the result reads them as plain scans."""
    query = rt.query_terms(queries)
    small, block_key = query.small, ["query_id", "block"]

    def kept(rows: DataFrame, label: str, dealt: bool = small) -> DataFrame:
        """``rows`` written by block; ``dealt`` says that they lie by block already, as where all that was joined otherwise was broadcast."""
        tables[label] = Buckets(rows if dealt else rows.repartition(blocks.tasks, "block"), "block", label, blocks.tasks)
        return tables[label].read()

    def plain(label: str) -> DataFrame:
        at = tables[label]
        return at.spark.read.schema(at.read().schema).parquet(at.path)

    known = rt.written(rt.known_terms(query, blocks.index).select("query_id", "term"), "known-terms")
    stored = tables["blocks"].read()
    lists = stored.select("term", "block", "n", "most")
    if small:
        # as many rows as the query terms, which are measured to be few
        lists = lists.join(F.broadcast(known), "term")
    else:
        counts = known.groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
        lists = salted_join(known, lists, ["term"], hot_keys(counts, ["term"], "rows"), ["query_id"])
    lists = kept(lists.select("query_id", "term", "block", "n", "most"), "maxima")
    terms = lists.groupBy("query_id", "term").agg(F.max("most").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("maxima"))
    by_rarity = Window.partitionBy("query_id").orderBy("n", "term")
    whole = Window.partitionBy("query_id")
    # a query's own terms; the rarest one always comes first
    terms = terms.withColumn("upto", F.sum("n").over(by_rarity)).withColumn("early", (
        (F.row_number().over(by_rarity) == 1) | (F.col("upto") <= FIRST_SHARE * F.sum("n").over(whole))))
    terms = rt.written(terms.drop("upto"), "query-terms")

    flags = terms.select("query_id", "term", "early")
    marked = rt._join_queries(lists, flags, small, ["block"], ["query_id", "term"])
    marked = marked if small else kept(marked, "lists")
    early = kept(_sums(_parts(stored, marked.filter("early"), small)), "early-parts")
    best = top_k(early, ["query_id"], [F.desc("part"), F.asc("doc_id")], FIRST_DOCS * k, "place").drop("place")
    first = kept(best.select(*block_key).repartition(blocks.tasks, "block").distinct(), "first-blocks", True)
    first_lists = kept(marked.filter("NOT early").join(first, block_key), "first-lists")
    seen = kept(_added(early.join(first, block_key, "left_semi"), _parts(stored, first_lists, small)), "first-scores")
    # one row per query; no score until there are k
    least = rt.written(_kth(seen, k), "least")

    # of the terms that may be left out, those that save the most postings for their maxima
    up_to = Window.partitionBy("query_id").orderBy(F.desc(F.col("n") / F.col("most")), "term")
    left_out = terms.filter("NOT early AND most > 0").withColumn("sum", F.sum("most").over(up_to)).join(least, "query_id").filter(
        F.col("sum") + MARGIN < F.col("least")).select("query_id", "term", F.lit(True).alias("left_out"))
    bounds = marked.groupBy(*block_key).agg(F.round(F.sum("most"), rt.SCORE_DIGITS).alias("bound"))
    live = rt._join_queries(bounds.join(first, block_key, "left_anti"), least, small, ["block"])
    live = kept(live.filter(F.col("least").isNull() | (F.col("bound") + MARGIN >= F.col("least"))).select(*block_key), "blocks-left")
    late = marked.filter("NOT early").join(live, block_key)
    late = late.join(F.broadcast(left_out) if small else left_out, ["query_id", "term"], "left")
    late = kept(late.withColumn("left_out", F.coalesce("left_out", F.lit(False))), "lists-left")
    needed = late.filter("NOT left_out")
    partial = kept(_added(early.join(live, block_key, "left_semi"), _parts(stored, needed, small)), "parts")

    # what is known of a document is a lower bound of its score
    better = rt.written(_kth(seen.unionByName(partial), k), "least")
    others = late.filter("left_out")
    room = others.groupBy(*block_key).agg(F.sum("most").alias("room"))
    alive = rt._join_queries(partial.join(room, block_key, "left"), better, small)
    alive = kept(alive.filter(F.col("least").isNull() | (F.col("part") + F.coalesce("room", F.lit(0.0)) + MARGIN >= F.col("least"))).select(
        *DOC_KEY, "part"), "documents-left")
    last_lists = kept(others.join(alive.select(*block_key).distinct(), block_key), "last-lists")
    rest = rt.written(_added(alive, _parts(stored, last_lists, small), "left"), "last-scores")
    hits = plain("first-scores").unionByName(rest)

    marked = rt._join_queries(plain("maxima"), flags, small, ["block"], ["query_id", "term"]) if small else plain("lists")
    read = [marked.filter("early"), plain("first-lists"), plain("lists-left").filter("NOT left_out"), plain("last-lists")]
    read = reduce(DataFrame.unionByName, [x.select("query_id", "n") for x in read]).groupBy("query_id").agg(F.sum("n").alias("postings_read"))
    everything = terms.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum("maxima").alias("maxima"))
    return Pruned(rt._best(hits.select("query_id", "doc_id", rt._score(F.col("part"))), k), everything.join(read, "query_id"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th best score of each query, NULL where there are fewer."""
    best = top_k(scores, ["query_id"], [F.desc("part"), F.asc("doc_id")], k)
    least = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("part").alias("least"))
    return least.select("query_id", F.when(F.col("hits") >= k, F.col("least")).alias("least"))
