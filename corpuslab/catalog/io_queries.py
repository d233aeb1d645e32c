"""Registered queries for sources and sinks. Each one writes given data and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from corpuslab.catalog import fixtures as fx
from corpuslab.catalog.fixtures import SQL_LINKS, SQL_QUERY_TERMS, sql_postings
from corpuslab.catalog.registry import query, table
from corpuslab.functions import text
from corpuslab.functions.scalar import rounded
from corpuslab.operators import retrieve as rt
from corpuslab.plans.storage import new_path
from corpuslab.sources import corpus, gridfiles, index_store, keyvalue

BODY50 = sql_postings("body", "documents", "doc_id", "text", 50)


@query("io_io1_read_corpus", """
SELECT doc_id AS id, CAST(length(text) AS INTEGER) AS n FROM documents""")
def read_corpus(spark, sf):
    path = new_path(spark, "corpus")
    table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").write.parquet(f"{path}/kept")
    docs = corpus.read_corpus(spark, f"{path}/kept", exclude=("skip-",))
    return docs.select("id", F.char_length("text").alias("n"))


@query("io_io1_excluded_file", "SELECT o_orderkey, o_custkey, CAST(NULL AS BIGINT) AS c_custkey FROM orders")
def excluded_file(spark, sf):
    """A scan of two tables that leaves out the files of one by their name."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("o_orderkey", "o_custkey", "c_custkey")])
    return corpus.read_corpus(spark, [f"{sf}/orders.parquet", f"{sf}/customer.parquet"], schema, exclude=("customer",))


@query("io_io2_read_links", f"WITH {SQL_LINKS} SELECT src AS id, dst, text FROM links")
def read_links(spark, sf):
    path = new_path(spark, "articles")
    pages = fx.anchored_pages(spark, sf).select(
        "id", F.lit("title").alias("title"), F.lit("text").alias("text"), "anchor_text")
    pages.write.parquet(f"{path}/pages-1")
    links = corpus.read_links(spark, f"{path}/pages-*")
    return links.select("id", F.explode("anchor_text").alias("a")).select("id", F.col("a.id").alias("dst"), "a.text")


@query("io_io3_read_pageviews", """
SELECT user_id AS id, CAST(floor(value) AS BIGINT) AS views FROM events WHERE event_id % 3 <> 0 AND event_id % 7 <> 0""")
def read_pageviews(spark, sf):
    path = new_path(spark, "pageviews")
    site = F.when(F.col("event_id") % 3 == 0, "de.wikipedia").otherwise("en.wikipedia")
    who = F.when(F.col("event_id") % 7 == 0, F.lit("null")).otherwise(F.col("user_id").cast("string"))
    line = F.concat_ws(" ", site, F.col("event_type"), who, F.lit("desktop"), F.floor("value").cast("string"), F.lit("A1"))
    table(spark, sf, "events").select(line).write.option("compression", "bzip2").text(path)
    return corpus.read_pageviews(spark, path)


ORDER_FRAME = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query("io_io4_read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def read_csv(spark, sf):
    path = new_path(spark, "orders-csv")
    cols = [c.split()[0] for c in ORDER_FRAME.split(", ")]
    table(spark, sf, "orders").select(*cols).write.option("header", True).csv(path)
    schema = spark.createDataFrame([], ORDER_FRAME).schema
    return corpus.read_csv(spark, path, schema)


@query("io_io5_read_query_set", """
SELECT 'source ' || source AS query, doc_id FROM documents""")
def read_query_set(spark, sf):
    """One JSON object per source of documents; the file format holds one object per file."""
    path = new_path(spark, "query-set")
    entry = F.concat(F.lit('"source '), F.col("source"), F.lit('": ['), F.array_join(F.collect_list("doc_id"), ", "), F.lit("]"))
    block = F.floor(F.col("doc_id") / 1000)
    docs = table(spark, sf, "documents").groupBy("source", block.alias("block")).agg(entry.alias("e"))
    docs.select(F.concat(F.lit("{"), F.col("e"), F.lit("}")).alias("value"), "block", "source").write.partitionBy(
        "block", "source").text(path)
    return corpus.read_query_set(spark, path)


@query("io_io6_read_words", "SELECT DISTINCT lower(p_name) AS word FROM part WHERE trim(p_name) <> ''")
def read_words(spark, sf):
    path = new_path(spark, "words")
    names = table(spark, sf, "part").select(F.lower("p_name").alias("w")).distinct()
    names.select(F.concat(F.lit("  "), F.col("w"), F.lit("  \n  "))).write.text(path)
    return corpus.read_words(spark, path)


@query("io_io7_key_value", "SELECT c_custkey AS id, c_name AS title FROM customer")
def key_value(spark, sf):
    path = new_path(spark, "titles")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    keyvalue.write_kv(names, path, fmt="text")
    return keyvalue.read_kv(spark, path, "title", "string")


@query("io_io8_sortedness", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, min(doc_id) AS first_key, max(doc_id) AS last_key, CAST(0 AS BIGINT) AS breaks FROM documents""")
def sortedness(spark, sf):
    path = new_path(spark, "lengths")
    keyvalue.write_kv(fx.body_index(spark, sf).doc_lengths, path)
    parts = keyvalue.sortedness(spark, path)
    return parts.agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"),
        F.sum("breaks").cast("bigint").alias("breaks"))


@query("io_io9_index_round_trip", f"""WITH {BODY50}
SELECT p.term, p.doc_id, p.tf, d.dl FROM body_post p JOIN body_terms USING (term) JOIN body_dl d USING (row_no)""")
def index_round_trip(spark, sf):
    path = new_path(spark, "index")
    index_store.write_index(fx.body_index(spark, sf, 50), path)
    return index_store.read_index(spark, path).postings.drop("bucket")


def _stored(spark, sf):
    def make():
        path = new_path(spark, "index")
        index_store.write_index(fx.body_index(spark, sf, 50), path)
        return path
    return fx.once(spark, sf, "stored-index", make)


@query("io_io10_index_terms", f"""WITH {BODY50}
SELECT p.term, p.doc_id, p.tf, d.dl FROM body_post p JOIN body_terms USING (term) JOIN body_dl d USING (row_no)
WHERE p.term IN ('tion', 'ention', 'eau')""")
def index_terms(spark, sf):
    return index_store.read_postings(spark, _stored(spark, sf), ["tion", "ention", "eau"]).drop("bucket")


@query("io_io10_search_index_files", f"""WITH {BODY50}, {SQL_QUERY_TERMS}
SELECT query_id, doc_id, term, p.tf FROM qterms JOIN body_terms USING (term) JOIN body_post p USING (term)""")
def search_index_files(spark, sf):
    """Postings of all query terms from index files; folders without a query term are skipped."""
    index = index_store.read_index(spark, _stored(spark, sf))
    return rt.matches(rt.query_terms(fx.queries(spark, sf)), index).select("query_id", "doc_id", "term", "tf")


def _stored_16(spark, sf):
    def make():
        path = new_path(spark, "index")
        index_store.write_index(fx.body_index(spark, sf, 50), path, buckets=16)
        return path
    return fx.once(spark, sf, "stored-index-16", make)


SQL_SEARCHED = f"""WITH {BODY50}, {SQL_QUERY_TERMS}
SELECT query_id, doc_id, term, p.tf FROM qterms JOIN body_terms USING (term) JOIN body_post p USING (term)"""


@query("io_io10_search_16_buckets", SQL_SEARCHED)
def search_16_buckets(spark, sf):
    """The same from an index of another bucket count, with a query table measured to be small."""
    index = index_store.read_index(spark, _stored_16(spark, sf))
    return rt.matches(rt.query_terms(fx.queries(spark, sf)), index).select("query_id", "doc_id", "term", "tf")


@query("io_io10_search_16_buckets_large", SQL_SEARCHED)
def search_16_buckets_large(spark, sf):
    """The same with the joins that a large query table takes."""
    index = index_store.read_index(spark, _stored_16(spark, sf))
    query_terms = rt.QueryTerms(rt.query_terms(fx.queries(spark, sf)).terms, False)
    return rt.matches(query_terms, index).select("query_id", "doc_id", "term", "tf")


@query("io_io11_index_stats", f"WITH {BODY50} SELECT CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl FROM body_stat")
def index_stats(spark, sf):
    stats = spark.read.parquet(_stored(spark, sf) + "/stats")
    return stats.select("n_docs", rounded(F.col("avgdl")).alias("avgdl"))


@query("io_io12_predictions", "SELECT o_orderkey AS video_id, o_totalprice AS prediction FROM orders")
def predictions(spark, sf):
    path = new_path(spark, "predictions")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_totalprice").alias("prediction"))
    corpus.write_predictions(rows, path)
    return corpus.read_csv(spark, path, spark.createDataFrame([], "video_id bigint, prediction double").schema)


@query("io_io13_grid_file", """
SELECT p_partkey AS row_idx, CAST(i AS INTEGER) AS col_idx, [p_name, p_brand, p_type][i + 1] AS value
FROM part, range(3) r(i)""")
def grid_file(spark, sf):
    path = new_path(spark, "grid")
    part = table(spark, sf, "part")
    cells = part.select(F.col("p_partkey").alias("row_idx"), F.posexplode(F.array("p_name", "p_brand", "p_type")).alias("col_idx", "value"))
    n_rows = part.agg(F.max("p_partkey")).first()[0] + 1
    gridfiles.write_grid(cells, n_rows, 3, path)
    return gridfiles.read_grid(spark, path)[0]
