"""Registered queries for tokens, words and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog.fixtures import SQL_QUERY_TERMS, sql_tokens
from corpuslab.catalog.registry import query, table
from corpuslab.functions import scalar, text
from corpuslab.functions.scalar import rounded
from corpuslab.sources.corpus import spread

DOC_TOKENS = sql_tokens("tok", "documents", "doc_id", "text")


@query("text_tx1_tokens", f"""
WITH {sql_tokens("tok", "documents", "doc_id", "text", stop=False)}
SELECT id AS doc_id, term, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY id, term""")
def tokens(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    words = docs.select("doc_id", text.unnest(text.raw_tokens(F.col("text"))).alias("term")).filter("term IS NOT NULL")
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("text_tx2_stop_words", f"""
WITH {DOC_TOKENS} SELECT id AS doc_id, CAST(count(*) AS BIGINT) AS n_kept, CAST(count(DISTINCT term) AS BIGINT) AS n_terms
FROM tok GROUP BY id""")
def without_stop_words(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    kept = docs.select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return kept.select(
        "doc_id", F.size("t").cast("bigint").alias("n_kept"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms")
    ).filter("n_kept > 0")


@query("text_tx3_term_frequency", f"""
WITH {DOC_TOKENS} SELECT id, term, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY id, term""")
def term_frequency(spark, sf):
    return text.term_counts(spread(table(spark, sf, "documents")), "doc_id", "text")


@query("text_tx4_token_count", f"""
WITH {DOC_TOKENS}, n AS (SELECT id, count(*) AS c FROM tok GROUP BY id)
SELECT doc_id, CAST(coalesce(c, 0) AS INTEGER) AS dl FROM documents LEFT JOIN n ON n.id = doc_id""")
def doc_token_count(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", text.token_count(text.tokenize(F.col("text"))).alias("dl"))


@query("text_tx5_query_length", f"""
WITH {SQL_QUERY_TERMS}, n AS (SELECT query_id, count(*) AS c FROM qterms GROUP BY query_id)
SELECT item_id AS query_id, CAST(greatest(coalesce(c, 0), 1) AS INTEGER) AS q_len
FROM benchmark LEFT JOIN n ON query_id = item_id""")
def query_length(spark, sf):
    bench = table(spark, sf, "benchmark")
    return bench.select(F.col("item_id").alias("query_id"), text.query_length(text.tokenize(F.col("text"))).alias("q_len"))


@query("text_tx6_last_token", r"""
SELECT p_partkey, coalesce(lower(list_last(regexp_extract_all(p_name, '[\p{L}\p{N}]+'))), '') AS last_word FROM part""")
def last_word(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.last_token(F.col("p_name")).alias("last_word"))


@query("text_tx6_last_token_documents", r"""
SELECT doc_id, coalesce(lower(list_last(regexp_extract_all(text, '[\p{L}\p{N}]+'))), '') AS last_word FROM documents""")
def last_word_documents(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", text.last_token(F.col("text")).alias("last_word"))


@query("text_tx7_text_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def text_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.char_length("text").alias("n"))


@query("text_tx8_join_texts", """
SELECT p_partkey, concat(coalesce(p_name, ''), ' ', coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_type END, '')) AS joined
FROM part""")
def join_texts(spark, sf):
    part = table(spark, sf, "part").withColumn("maybe", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")))
    return part.select("p_partkey", text.join_texts(F.col("p_name"), F.col("maybe")).alias("joined"))


@query("text_tx9_term_bucket", f"""WITH {DOC_TOKENS}
SELECT CAST(124 AS BIGINT) AS n_buckets, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM tok""")
def term_bucket(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    terms = text.term_counts(docs, "doc_id", "text").select("term").distinct()
    sizes = terms.groupBy(text.bucket_of(F.col("term")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("bucket").between(0, 123)).agg(
        F.count(F.lit(1)).alias("n_buckets"), F.sum("n").alias("n_terms"))


@query("functions_sc1_math", """
SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) + 0 AS ln_x, round(ln(1 + l_quantity), 6) + 0 AS log1p_x,
  round(sqrt(l_extendedprice), 6) + 0 AS sqrt_x, round(pow(l_quantity, 2), 6) + 0 AS pow_x, round(sin(l_quantity), 6) + 0 AS sin_x,
  round(cos(l_quantity), 6) + 0 AS cos_x, round(abs(l_discount - l_tax), 6) + 0 AS abs_x, round(exp(l_discount), 6) + 0 AS exp_x
FROM lineitem""")
def math_functions(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(F.log(p)).alias("ln_x"), rounded(F.log1p(q)).alias("log1p_x"),
        rounded(F.sqrt(p)).alias("sqrt_x"), rounded(F.pow(q, F.lit(2))).alias("pow_x"), rounded(F.sin(q)).alias("sin_x"),
        rounded(F.cos(q)).alias("cos_x"), rounded(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("abs_x"),
        rounded(F.exp("l_discount")).alias("exp_x"),
    )


# Every fifth event has a time text that cannot be read.
SQL_TIME = "CASE WHEN event_id % 5 <> 0 THEN ts END"


def _timed(spark, sf):
    written = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("not a time"))
    return table(spark, sf, "events").withColumn("read", scalar.parse_time(written))


@query("functions_sc2_time_parts", f"""
SELECT event_id, CAST(hour({SQL_TIME}) AS INTEGER) AS hour, CAST(isodow({SQL_TIME}) - 1 AS INTEGER) AS dow FROM events""")
def time_parts(spark, sf):
    return _timed(spark, sf).select("event_id", F.hour("read").alias("hour"), scalar.day_of_week(F.col("read")).alias("dow"))


@query("functions_sc3_sunday_first", "SELECT event_id, CAST(dayofweek(ts) AS INTEGER) AS day FROM events")
def sunday_first(spark, sf):
    day = scalar.sunday_first(scalar.day_of_week(F.col("ts")))
    return table(spark, sf, "events").select("event_id", day.alias("day"))


@query("functions_sc4_cyclic", """
SELECT event_id, round(sin(2 * pi() * hour(ts) / 24.0), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24.0), 6) + 0 AS hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7.0), 6) + 0 AS day_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7.0), 6) + 0 AS day_cos
FROM events""")
def cyclic(spark, sf):
    hs, hc = scalar.cyclic(F.hour("ts"), 24)
    ds, dc = scalar.cyclic(scalar.day_of_week(F.col("ts")), 7)
    return table(spark, sf, "events").select(
        "event_id", rounded(hs).alias("hour_sin"), rounded(hc).alias("hour_cos"),
        rounded(ds).alias("day_sin"), rounded(dc).alias("day_cos"))


@query("functions_sc5_ratios", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / (l_quantity + 1), 8) + 0 AS ratio,
  round(l_quantity + l_discount + l_tax, 6) + 0 AS total, round(l_quantity * l_discount, 6) + 0 AS product,
  round(l_quantity * l_quantity, 6) + 0 AS square, round(ln(1 + l_extendedprice), 6) + 0 AS log_price FROM lineitem""")
def ratios(spark, sf):
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(scalar.safe_ratio(p, q), 8).alias("ratio"),
        rounded(q + d + F.col("l_tax")).alias("total"), rounded(q * d).alias("product"),
        rounded(q * q).alias("square"), rounded(F.log1p(p)).alias("log_price"))


@query("functions_sc6_id_text", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id_text FROM documents")
def id_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id_text"))


@query("functions_sc7_rescale", """
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CAST(embedding[i + 1] AS DOUBLE) / 255.0, 6) + 0 AS x
FROM embeddings, range(64) r(i)""")
def rescale(spark, sf):
    vecs = table(spark, sf, "embeddings").select("vec_id", scalar.rescale(F.col("embedding").cast("array<double>")).alias("v"))
    return vecs.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", rounded(F.col("x")).alias("x"))
