"""Ranked retrieval for whole tables of queries (query_id, text)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslab.functions import text
from corpuslab.operators.index import Index, doc_norms, doc_terms
from corpuslab.plans.ranking import full_rank, top_k
from corpuslab.plans.skew import fits_broadcast, hot_keys, join_small_or_salted, salted_join
from corpuslab.plans.storage import written

# Scores are rounded to this many digits before ranking, so that the order in
# which partial sums arrive cannot change the order of equal documents.
SCORE_DIGITS = 9

# Limits and weights of the fused search.
BODY_POOL = 1000
CANDIDATES = 500
RESULTS = 100
WEIGHTS = (0.40, 0.40, 0.20)
BOOSTS = (0.05, 0.05)

# Numbers that a task holds of the documents it scores together: sums of all queries, and matches.
CELLS = 4_000_000


@dataclass
class QueryTerms:
    """(query_id, term, qtf), and whether the table was measured to be small."""

    terms: DataFrame
    small: bool


def query_terms(queries: DataFrame, stop_words: tuple[str, ...] | None = None) -> QueryTerms:
    """Distinct terms of each query with their counts. A query without tokens gives no row."""
    counted = doc_terms(queries, "query_id", "text", stop_words).withColumnRenamed("id", "query_id")
    rows = counted.select("query_id", text.unnest(F.col("counts")).alias("c")).filter("c IS NOT NULL")
    rows = rows.select("query_id", F.col("c.term").alias("term"), F.col("c.tf").alias("qtf"))
    return QueryTerms(rows, fits_broadcast(rows))


def known_terms(query: QueryTerms, index: Index) -> DataFrame:
    """Query terms that the index knows, with their df."""
    table = index.terms.select("term", "df")
    if query.small:
        return table.join(F.broadcast(query.terms), "term")
    counts = query.terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(query.terms, table, ["term"], hot_keys(counts, ["term"], "n"), ["query_id"])


def matches(query: QueryTerms, index: Index, known: DataFrame | None = None) -> DataFrame:
    """Postings of all query terms: query_id, term, qtf, df, doc_id, tf, dl.

    Index files lie in one folder per term bucket; folders that no term of a
    small query table falls into are not read.
    """
    known = known_terms(query, index) if known is None else known
    postings = index.postings
    if query.small and index.buckets and "bucket" in postings.columns:
        used = known.select(text.bucket_of(F.col("term"), index.buckets).alias("b")).distinct().collect()  # at most one row per folder
        postings = postings.filter(F.col("bucket").isin([r["b"] for r in used]))
    postings = postings.select("term", "doc_id", "tf", "dl")
    if query.small:
        # terms are unique in the index, so this is no larger than the measured table
        return postings.join(F.broadcast(known), "term")
    # a term weighs as much as the rows it gives: its postings times its queries
    pairs = known.groupBy("term").agg((F.count(F.lit(1)) * F.max("df")).alias("n"))
    return salted_join(postings, known, ["term"], hot_keys(pairs, ["term"], "n"), ["doc_id"])


def _score(value: Column) -> Column:
    return F.round(value, SCORE_DIGITS).alias("score")


def _best(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def search_tfidf(
    queries: DataFrame, index: Index, k: int = RESULTS, pool: int = BODY_POOL, norms: DataFrame | None = None
) -> DataFrame:
    """Cosine of tf-idf vectors: query_id, doc_id, score, rank."""
    query = query_terms(queries)
    idf = F.log(F.lit(float(index.n_docs)) / F.col("df"))
    q_weight = (1 + F.log("qtf")) * idf
    known = written(known_terms(query, index), "known-terms")
    q_norm = known.groupBy("query_id").agg(F.sqrt(F.sum(q_weight * q_weight)).alias("q_norm"))
    dots = (
        matches(query, index, known)
        .groupBy("query_id", "doc_id")
        .agg(F.sum((1 + F.log("tf")) * idf * q_weight).alias("dot"))
    )
    norms = (doc_norms(index) if norms is None else norms).withColumnRenamed("id", "doc_id").filter("norm > 0")
    scored = _join_queries(dots.join(norms, "doc_id"), q_norm.filter("q_norm > 0"), query.small).select(
        "query_id", "doc_id", _score(F.col("dot") / (F.col("norm") * F.col("q_norm")))
    )
    return _best(scored, min(k, pool))


def _join_queries(
    rows: DataFrame, per_query: DataFrame, small: bool, salt_by: list[str] = ["doc_id"], keys: list[str] = ["query_id"]
) -> DataFrame:
    """Join one row per query, or per query and term, onto result rows; a key may own a large share of the rows."""
    if small:
        return rows.join(F.broadcast(per_query), keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return salted_join(rows, per_query, keys, hot_keys(counts, keys, "n"), salt_by)


def _bm25_idf(index: Index) -> Column:
    return F.log(1 + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25_weight(index: Index, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 part of one posting. A missing or zero length counts as the whole part of the mean."""
    idf = _bm25_idf(index)
    length = F.coalesce(F.nullif(F.col("dl"), F.lit(0)), F.lit(int(index.avgdl)))
    tf = F.col("tf").cast("double")
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (length / F.lit(float(index.avgdl)))))


def search_bm25(
    queries: DataFrame, index: Index, k1: float = 1.2, b: float = 0.75, k: int = BODY_POOL, query: QueryTerms | None = None
) -> DataFrame:
    """BM25 over distinct query terms: query_id, doc_id, score, rank. ``query`` holds the terms where they are known.

    Where the rows of the documents are at hand and the query terms few, the terms travel to the rows and
    each is scored where it lies, so that only rows that may be among the best are shuffled.
    """
    query = query_terms(queries) if query is None else query
    if query.small and index.counted is not None:
        return _best(_scored_in_rows(query, index, k1, b, k), k)
    scored = matches(query, index).groupBy("query_id", "doc_id").agg(_score(F.sum(bm25_weight(index, k1, b))))
    return _best(scored, k)


def _scored_in_rows(query: QueryTerms, index: Index, k1: float, b: float, k: int) -> DataFrame:
    """(query_id, doc_id, score) of all documents that may be among the ``k`` best of a query.

    A document whose id only one row has gets its whole score there. Ids of several rows get
    the sum over them; nothing of theirs is left out before.
    """
    scores = _RowScores(known_terms(query, index).select("query_id", "term", _bm25_idf(index).alias("idf")), index, k1, b)
    docs = index.counted.select("id", "dl", "counts")
    repeated = docs.groupBy(F.col("id").alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again")
    parts = ["query_id", "doc_id"]
    if repeated.isEmpty():
        return scores.of(docs, k).select(*parts, _score(F.col("part")))
    if not fits_broadcast(repeated):
        return scores.of(docs).groupBy(*parts).agg(_score(F.sum("part")))
    few, same = F.broadcast(repeated), F.col("id").eqNullSafe(F.col("again"))
    alone = scores.of(docs.join(few, same, "left_anti"), k).select(*parts, _score(F.col("part")))
    return alone.unionByName(scores.of(docs.join(few, same, "left_semi")).groupBy(*parts).agg(_score(F.sum("part"))))


class _RowScores:
    """BM25 of whole rows (id, dl, counts) for query terms (query_id, term, idf) that were measured to be few."""

    def __init__(self, known: DataFrame, index: Index, k1: float, b: float):
        self.k1, self.b, self.avgdl = k1, b, float(index.avgdl)
        table = known.orderBy("term").toArrow()
        terms = table["term"].combine_chunks().dictionary_encode()
        asked = table["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        of_term = terms.indices.to_numpy()
        # rows of one term lie together: where they start, and how many they are
        first, count = np.unique(of_term, return_index=True, return_counts=True)[1:]
        # (terms, their first row, rows and idf, place of the query of each row, query ids)
        self.table = known.sparkSession.sparkContext.broadcast((
            terms.dictionary, first, count, table["idf"].to_numpy()[first], asked.indices.to_numpy().astype(np.int64), asked.dictionary))

    def of(self, docs: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, part): a row per document and query that share a term. With ``k``, those that ``k`` others
        of the task surpass are left out."""
        table, k1, b, avgdl = self.table, self.k1, self.b, self.avgdl

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, first, count, idf, query_of, query_ids = table.value
            n_queries = len(query_ids)
            least = np.zeros(n_queries)
            for batch in batches:
                if not n_queries:
                    continue
                lists = batch.column("counts")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                entries = lists.flatten()
                at = pc.index_in(entries.field("term"), value_set=vocabulary)
                known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                term = at.take(pa.array(known)).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), sizes)[known]
                tf = entries.field("tf").to_numpy()[known].astype(np.float64)
                length = pc.fill_null(batch.column("dl"), 0).to_numpy(zero_copy_only=False).astype(np.float64)
                length[length == 0] = int(avgdl)
                part = idf[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (length[row] / avgdl)))
                # rows are taken together as long as their sums and matches are few enough
                cost = np.cumsum(n_queries + np.bincount(row, count[term], batch.num_rows))
                start = 0
                while start < batch.num_rows:
                    before = cost[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(cost, before + CELLS, "right")))
                    lo, hi = np.searchsorted(row, [start, end])
                    t = term[lo:hi]
                    match = np.repeat(np.arange(lo, hi), count[t])
                    # the n-th match of a posting is the n-th row of its term
                    nth = np.arange(len(match)) - np.repeat(np.cumsum(count[t]) - count[t], count[t])
                    cell = (row[match] - start) * n_queries + query_of[first[term[match]] + nth]
                    sums = np.bincount(cell, part[match], (end - start) * n_queries)
                    found = np.zeros(len(sums), dtype=bool)
                    found[cell] = True
                    if k is not None:
                        grid = sums.reshape(end - start, n_queries)
                        if end - start > k:
                            least = np.maximum(least, np.partition(grid, end - start - k, axis=0)[end - start - k])
                        # what is less by this much stays less when it is rounded
                        found &= (grid >= least - 10.0 ** -SCORE_DIGITS * 2).ravel()
                    hit = np.flatnonzero(found)
                    doc_ids = batch.column("id").take(pa.array(start + hit // n_queries))
                    yield pa.RecordBatch.from_arrays(
                        [query_ids.take(pa.array(hit % n_queries)), doc_ids, pa.array(sums[hit])], ["query_id", "doc_id", "part"])
                    start = end

        return docs.mapInArrow(score, "query_id bigint, doc_id bigint, part double")


def coverage(query: QueryTerms, index: Index, mode: str = "occurrence") -> DataFrame:
    """(query_id, doc_id, score): matching postings, or distinct matching terms."""
    hits = matches(query, index)
    if mode == "distinct":
        hits = hits.select("query_id", "doc_id", "term").distinct()
    elif mode != "occurrence":
        raise ValueError(f"mode must be 'occurrence' or 'distinct', not {mode!r}")
    return hits.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))


def search_title(queries: DataFrame, index: Index) -> DataFrame:
    """All documents by the number of distinct query terms in the title."""
    return full_rank(coverage(query_terms(queries), index), "query_id", "score", "doc_id")


def search_anchor(queries: DataFrame, index: Index, mode: str = "occurrence") -> DataFrame:
    """All documents by query terms in the texts of links that point to them."""
    return full_rank(coverage(query_terms(queries), index, mode), "query_id", "score", "doc_id")


def max_normalize(scores: DataFrame, small_queries: bool, ranked: bool = False) -> DataFrame:
    """Divide by the largest score of the query; a zero maximum counts as 1.

    ``ranked`` says that the list is a top-k result: few rows per query, already
    placed by query, so a window finds the maximum. A list of any length gets it
    by aggregation and a join.
    """
    if ranked:
        rows = scores.withColumn("top", F.max("score").over(Window.partitionBy("query_id")))
    else:
        top = scores.groupBy("query_id").agg(F.max("score").alias("top"))
        rows = _join_queries(scores, top, small_queries)
    return rows.select(
        "query_id", "doc_id", (F.col("score") / F.coalesce(F.nullif(F.col("top"), F.lit(0)), F.lit(1))).alias("score")
    )


def fuse(signals: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of scored lists; a document missing from a list adds nothing."""
    merged = None
    for scores, weight in signals:
        part = scores.select("query_id", "doc_id", (F.col("score") * F.lit(weight)).alias("score"))
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy("query_id", "doc_id").agg(_score(F.sum("score")))


def fused_scores(
    queries: DataFrame, body: Index, title: Index, anchor: Index, weights: tuple[float, float, float] = WEIGHTS,
    body_hits: DataFrame | None = None,
) -> DataFrame:
    """Body BM25, title coverage and anchor coverage, normalised per query and added up.

    ``body_hits`` are the rows of :func:`search_bm25` where another search has found them. Dividing title and anchor scores by the query length has no effect on the
    result, since the division by the maximum follows.
    """
    query = query_terms(queries)
    signals = [
        max_normalize(search_bm25(queries, body, query=query) if body_hits is None else body_hits, query.small, ranked=True),
        max_normalize(coverage(query, title), query.small),
        max_normalize(coverage(query, anchor), query.small),
    ]
    return fuse(list(zip(signals, weights)))


def attach_values(rows: DataFrame, table: DataFrame, key: str = "doc_id", max_rows: int | None = None) -> DataFrame:
    """Left join of a value table (id, ...) with one row per id onto result rows.

    A table of few wanted ids is cut to them and broadcast; beyond that limit an id that many
    queries found is spread over tasks.
    """
    wanted = rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    if fits_broadcast(wanted, max_rows):
        few = table.join(F.broadcast(wanted.select("id")), "id", "left_semi")
        return rows.join(F.broadcast(few.withColumnRenamed("id", key)), key, "left")
    hot = hot_keys(wanted.withColumnRenamed("id", key), [key], "__n")
    return salted_join(rows, table.withColumnRenamed("id", key), [key], hot, [c for c in rows.columns if c != key], "left")


def boost(
    candidates: DataFrame, pagerank: DataFrame, views: DataFrame, boosts: tuple[float, float] = BOOSTS,
    max_rows: int | None = None,
) -> DataFrame:
    """Add popularity: log1p of each signal over its maximum among the query's candidates."""
    rows = attach_values(attach_values(candidates, pagerank, max_rows=max_rows), views, max_rows=max_rows)
    pr = F.log1p(F.coalesce("pagerank", F.lit(0.0)))
    pv = F.log1p(F.coalesce(F.col("views").cast("double"), F.lit(0.0)))
    rows = rows.select("query_id", "doc_id", "score", pr.alias("pr"), pv.alias("pv"))
    tops = rows.groupBy("query_id").agg(F.max("pr").alias("mpr"), F.max("pv").alias("mpv"))

    def share(value: str, top: str) -> Column:
        return F.col(value) / F.when(F.col(top) > 0, F.col(top)).otherwise(F.lit(1.0))

    # a query has at most `candidates` rows here, so no key can be hot
    return rows.join(tops, "query_id").select(
        "query_id", "doc_id",
        _score(F.col("score") + boosts[0] * share("pr", "mpr") + boosts[1] * share("pv", "mpv")),
    )


def search(
    queries: DataFrame,
    body: Index,
    title: Index,
    anchor: Index,
    pagerank: DataFrame,
    views: DataFrame,
    titles: DataFrame,
    weights: tuple[float, float, float] = WEIGHTS,
    boosts: tuple[float, float] = BOOSTS,
    candidates: int = CANDIDATES,
    k: int = RESULTS,
    body_hits: DataFrame | None = None,
) -> DataFrame:
    """Fused search: query_id, rank, doc_id, title, score.

    ``body_hits`` may come from :func:`corpuslab.operators.blockmax.search_bm25`. Popularity and titles are looked up only for documents that survive the cut.
    """
    pool = _best(fused_scores(queries, body, title, anchor, weights, body_hits), candidates)
    pool = written(pool.select("query_id", "doc_id", "score"), "candidates")
    results = written(_best(boost(pool, pagerank, views, boosts), k), "results")
    return attach_values(results, titles.select("id", "title")).select("query_id", "rank", "doc_id", "title", "score")


def lookup(ids: DataFrame, table: DataFrame, value: str, default) -> DataFrame:
    """(..., pos, id, value) for an array column ``ids``; pos keeps the input order, duplicates stay.

    An id that very many requests ask for is spread over tasks by position.
    """
    others = [c for c in ids.columns if c != "ids"]
    rows = ids.select(*others, F.posexplode("ids").alias("pos", "id"))
    return join_small_or_salted(rows, table.select("id", value), ["id"], [*others, "pos"], "left").select(
        *others, "pos", "id", F.coalesce(F.col(value), F.lit(default)).alias(value)
    )
