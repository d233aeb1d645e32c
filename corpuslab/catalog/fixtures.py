"""Inputs that the registered queries share: the given tables in the shapes the operators take.

Documents stand in for articles, page titles for article titles (ids are shared),
page links for anchors (a link path names its target document by a fixed hash),
event users for page views, benchmark passages for queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslab.catalog.registry import table
from corpuslab.functions.text import TOKEN_PATTERN, all_stop_words
from corpuslab.operators import blockmax, graph, index as ix
from corpuslab.plans.skew import hot_keys, salted_join
from corpuslab.plans.storage import written
from corpuslab.sources.corpus import spread  # noqa: F401

TITLE = "<title>([^<]*)</title>"
LINK = '<a href="([^"]*)"[^>]*>([^<]*)</a>'

_kept: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """Build a shared input once per Spark application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract("html", TITLE, 1).alias("title")
    )


def anchored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, anchor_text): pages with their links as an array of (target id, text), NULL without links."""
    n_docs = table(spark, sf_dir, "documents").count()

    def target(path):
        return F.conv(F.substring(F.md5(path), 1, 7), 16, 10).cast("long") % n_docs

    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("path"),
        F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("text"),
    )
    found = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), pairs.alias("pairs"))
    anchors = F.transform("pairs", lambda a: F.struct(target(a["path"]).alias("id"), a["text"].alias("text")))
    return found.select("id", F.when(F.size("pairs") > 0, anchors).alias("anchor_text"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.popularity(
        table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.lit(1).cast("long").alias("views"))
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def body_index(spark: SparkSession, sf_dir: str, min_postings: int = 0) -> ix.Index:
    return once(spark, sf_dir, f"body{min_postings}", lambda: ix.build_index(
        table(spark, sf_dir, "documents"), "doc_id", "text", min_postings))


def body_blocks(spark: SparkSession, sf_dir: str) -> blockmax.BlockIndex:
    return once(spark, sf_dir, "body-blocks", lambda: blockmax.build_blocks(body_index(spark, sf_dir)))


def title_index(spark: SparkSession, sf_dir: str, min_postings: int = 0) -> ix.Index:
    return once(spark, sf_dir, f"title{min_postings}", lambda: ix.build_index(
        titles(spark, sf_dir), "id", "title", min_postings))


def anchor_index(spark: SparkSession, sf_dir: str, min_postings: int = 0) -> ix.Index:
    return once(spark, sf_dir, f"anchor{min_postings}", lambda: ix.build_anchor_index(
        anchored_pages(spark, sf_dir), "anchor_text", min_postings))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_from_links(anchored_pages(spark, sf_dir), "id", "anchor_text")


def link_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pagerank) of the page link graph."""
    def make():
        edges = link_edges(spark, sf_dir)
        sources = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
        return written(graph.pagerank(edges, graph.vertices(edges, sources)), "pagerank")
    return once(spark, sf_dir, "link-ranks", make)


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): documents that hold the longest term of the query (ties: last in order)."""
    from corpuslab.operators.retrieve import query_terms

    asked = query_terms(queries(spark, sf_dir))
    key = asked.terms.groupBy("query_id").agg(
        F.max(F.struct(F.char_length("term").alias("n"), "term")).alias("best")
    ).select("query_id", F.col("best.term").alias("term"))
    def make():
        index = body_index(spark, sf_dir)
        if asked.small:
            # one row per query: postings stay where they are
            found = index.postings.select("term", "doc_id").join(F.broadcast(key), "term")
            return written(found.select("query_id", "doc_id"), "relevant")
        # a query has one such term; a term weighs as much as the rows it gives
        weights = index.terms.join(key, "term").groupBy("term").agg((F.count(F.lit(1)) * F.max("df")).alias("n"))
        found = salted_join(index.postings.select("term", "doc_id"), key, ["term"], hot_keys(weights, ["term"], "n"), ["doc_id"])
        return written(found.select("query_id", "doc_id"), "relevant")
    return once(spark, sf_dir, "relevant", make)


# ---- the same inputs as SQL common table expressions -------------------------------

def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_STOP = "(" + ", ".join(sql_str(w) for w in all_stop_words()) + ")"
SQL_TOKEN = sql_str(TOKEN_PATTERN)


def sql_tokens(name: str, source: str, key: str, text: str, stop: bool = True) -> str:
    """CTE (id, row_no, term): one row per token. row_no numbers the source rows."""
    keep = f" WHERE term NOT IN {SQL_STOP}" if stop else ""
    return f"""{name}_rows AS (SELECT {key} AS id, {text} AS text, row_number() OVER () AS row_no FROM {source}),
{name} AS (SELECT * FROM (SELECT id, row_no, unnest(regexp_extract_all(lower(coalesce(text, '')), {SQL_TOKEN})) AS term
  FROM {name}_rows){keep})"""


SQL_TITLES = f"titles AS (SELECT page_id AS id, regexp_extract(html, {sql_str(TITLE)}, 1) AS title FROM pages)"
SQL_LINKS = f"""links AS (SELECT src, path, text,
  CAST('0x' || substr(md5(path), 1, 7) AS BIGINT) % (SELECT count(*) FROM documents) AS dst
  FROM (SELECT page_id AS src, unnest(regexp_extract_all(html, {sql_str(LINK)}, 1)) AS path,
               unnest(regexp_extract_all(html, {sql_str(LINK)}, 2)) AS text FROM pages))"""
SQL_LINK_LISTS = f"""link_lists AS (SELECT src, pos,
  CAST('0x' || substr(md5(path), 1, 7) AS BIGINT) % (SELECT count(*) FROM documents) AS dst
  FROM (SELECT page_id AS src, unnest(l) AS path, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT page_id, regexp_extract_all(html, {sql_str(LINK)}, 1) AS l FROM pages)))"""
SQL_VIEWS = "views AS (SELECT user_id AS id, CAST(count(*) AS BIGINT) AS views FROM events GROUP BY user_id)"


def sql_postings(name: str, source: str, key: str, text: str, min_postings: int = 0) -> str:
    """CTEs {name}_post (term, doc_id, tf), {name}_terms (term, df, term_total), {name}_dl (id, dl), {name}_stat (n, avgdl)."""
    return sql_tokens(f"{name}_tok", source, key, text) + f""",
{name}_post AS (SELECT term, any_value(id) AS doc_id, row_no, CAST(count(*) AS INTEGER) AS tf FROM {name}_tok GROUP BY term, row_no),
{name}_terms AS (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS term_total FROM {name}_post
  GROUP BY term HAVING count(*) > {min_postings}),
{name}_len AS (SELECT row_no, count(*) AS dl FROM {name}_tok GROUP BY row_no),
{name}_dl AS (SELECT r.row_no, r.id, CAST(coalesce(l.dl, 0) AS INTEGER) AS dl FROM {name}_tok_rows r LEFT JOIN {name}_len l USING (row_no)),
{name}_stat AS (SELECT count(*) AS n, coalesce(avg(dl), 0.0) AS avgdl FROM {name}_dl)"""


SQL_QUERY_TERMS = sql_tokens("qtok", "benchmark", "item_id", "text") + """,
qterms AS (SELECT id AS query_id, term, count(*) AS qtf FROM qtok GROUP BY id, term)"""
