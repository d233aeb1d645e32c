"""Registered queries for filters, joins, aggregates, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import fixtures as fx
from corpuslab.catalog.fixtures import SQL_LINK_LISTS, SQL_LINKS, SQL_QUERY_TERMS, SQL_STOP, SQL_TITLES, sql_tokens
from corpuslab.catalog.registry import query, table
from corpuslab.catalog.search_queries import ANCHOR0, BODY0, BODY50, COVER, NORMS, QRELS, TITLE0, id_lists
from corpuslab.functions import text
from corpuslab.functions.scalar import rounded
from corpuslab.operators import index as ix, ireval, relational as rel, retrieve as rt
from corpuslab.plans.quantiles import exact_quantiles
from corpuslab.plans.ranking import top_k
from corpuslab.plans.skew import attach_stats

# NULLs at fixed places stand for missing measurements.
SQL_GAPS = """gaps AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, o_orderstatus AS status, o_orderdate AS day FROM orders)"""


def gaps(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("day"))


# ---- projection and filters ---------------------------------------------------------

@query("filter_pf1_cast_rename", "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS INTEGER) AS balance FROM customer")
def cast_rename(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long").alias("id"), F.bround("c_acctbal").cast("int").alias("balance"))


@query("filter_pf2_arity", """
SELECT p_partkey, string_split(p_name, ' ')[1] AS head, string_split(p_name, ' ')[2] AS tail FROM part
WHERE len(string_split(p_name, ' ')) = 2""")
def arity(spark, sf):
    parts = F.split("p_name", " ")
    return table(spark, sf, "part").filter(F.size(parts) == 2).select(
        "p_partkey", F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("tail"))


@query("filter_pf3_anchor_rows", f"""WITH {SQL_LINKS}
SELECT dst AS id, text FROM links WHERE text <> '' AND dst % 5 <> 0""")
def anchor_rows(spark, sf):
    pages = fx.anchored_pages(spark, sf)
    holes = F.transform("anchor_text", lambda a: F.struct(F.when(a["id"] % 5 != 0, a["id"]).alias("id"), a["text"].alias("text")))
    return ix.anchor_rows(pages.withColumn("anchor_text", holes), "anchor_text")


@query("filter_pf4_frequent_terms", f"""WITH {BODY50} SELECT p.doc_id, p.term, p.tf FROM body_post p JOIN body_terms USING (term)""")
def frequent_terms(spark, sf):
    postings = fx.body_index(spark, sf).postings
    return rel.frequent_groups(postings, ["term"], 50, ["doc_id"]).select("doc_id", "term", "tf")


@query("filter_pf5_quantile_split", f"""WITH {SQL_GAPS},
t AS (SELECT quantile_cont(price, 0.02) AS x FROM gaps)
SELECT price <= x AS low, round(avg(o_custkey), 6) AS mean, CAST(count(o_custkey) AS BIGINT) AS n FROM gaps, t
WHERE price IS NOT NULL GROUP BY 1""")
def quantile_split(spark, sf):
    return rel.split_at_quantile(gaps(spark, sf), "price", "o_custkey", 0.02).withColumn("mean", rounded(F.col("mean")))


@query("filter_pf6_frequent_users", """
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 70)""")
def frequent_users(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return rel.frequent_groups(events, ["user_id"], 70, ["event_id"]).select("event_id", "user_id")


@query("filter_pf7_drop_nulls", f"WITH {SQL_GAPS} SELECT * FROM gaps WHERE price IS NOT NULL AND priority IS NOT NULL")
def drop_nulls(spark, sf):
    return gaps(spark, sf).dropna(subset=["price", "priority"])


@query("filter_pf8_indicator", "SELECT o_orderkey, CAST(o_totalprice <= 50000 AS INTEGER) AS low FROM orders")
def indicator(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") <= 50000).cast("int").alias("low"))


# ---- joins --------------------------------------------------------------------------

@query("join_jn1_query_postings", f"""WITH {BODY0}, {SQL_QUERY_TERMS}
SELECT query_id, doc_id, term, CAST(qtf AS INTEGER) AS qtf, tf FROM qterms JOIN body_post USING (term)""")
def query_postings(spark, sf):
    found = rt.matches(rt.query_terms(fx.queries(spark, sf)), fx.body_index(spark, sf))
    return found.select("query_id", "doc_id", "term", "qtf", "tf")


@query("join_jn2_postings_df", f"WITH {BODY50} SELECT term, doc_id, df FROM body_post JOIN body_terms USING (term)")
def postings_df(spark, sf):
    return fx.body_index(spark, sf, 50).kept_postings().select("term", "doc_id", "df")


@query("join_jn3_length_default", f"""WITH {TITLE0}
SELECT r.doc_id, CAST(coalesce(nullif(dl, 0), CAST(floor(avgdl) AS INTEGER)) AS INTEGER) AS dl
FROM documents r LEFT JOIN title_dl d ON d.id = r.doc_id, title_stat""")
def length_default(spark, sf):
    index = fx.title_index(spark, sf)  # not every document has a title
    known = index.doc_lengths.withColumnRenamed("id", "doc_id")
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(known, "doc_id", "left").select(
        "doc_id", F.coalesce(F.nullif(F.col("dl"), F.lit(0)), F.lit(int(index.avgdl))).alias("dl"))


@query("join_jn4_norms", f"""WITH {BODY50}, {NORMS.format(b='body')}
SELECT doc_id, round(sum(tf) / any_value(norm), 6) + 0 AS score FROM body_post JOIN body_norm ON id = doc_id WHERE norm > 0 GROUP BY doc_id""")
def norms(spark, sf):
    index = fx.body_index(spark, sf, 50)
    sums = index.postings.groupBy(F.col("doc_id").alias("id")).agg(F.sum("tf").alias("s"))
    found = sums.join(ix.doc_norms(index).filter("norm > 0"), "id")
    return found.select(F.col("id").alias("doc_id"), rounded(F.col("s") / F.col("norm")).alias("score"))


@query("join_jn5_titles", f"WITH {SQL_TITLES} SELECT doc_id, title FROM documents LEFT JOIN titles ON id = doc_id")
def titles(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(fx.titles(spark, sf).withColumnRenamed("id", "doc_id"), "doc_id", "left")


@query("join_jn6_positional_lookup", f"""WITH {SQL_LINK_LISTS},
titles AS (SELECT s_suppkey AS id, s_name AS title FROM supplier)
SELECT src, pos, dst AS id, coalesce(title, 'no title') AS title FROM link_lists LEFT JOIN titles ON id = dst""")
def positional_lookup(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return rt.lookup(id_lists(spark, sf), names, "title", "no title")


@query("join_jn7_self_count", """
SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS uploads FROM events""")
def self_count(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return rel.attach_count(events, "user_id", "uploads", ["event_id"]).select("event_id", "user_id", "uploads")


@query("join_jn8_train_counts", """
WITH train AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00'),
c AS (SELECT user_id, count(*) AS uploads FROM train GROUP BY user_id)
SELECT event_id, user_id, CAST(coalesce(uploads, 1) AS BIGINT) AS uploads
FROM events LEFT JOIN c USING (user_id) WHERE NOT ts < TIMESTAMP '2024-01-01 06:00:00'""")
def train_counts(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    early = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-01 06:00:00'")
    learned = events.filter(early).groupBy("user_id").agg(F.count(F.lit(1)).alias("uploads"))
    return rel.apply_counts(events.filter(~early), learned, "user_id", "uploads", ["event_id"]).select("event_id", "user_id", "uploads")


SQL_HOLES = "holes AS (SELECT doc_id, source, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents)"


def _holes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))


SQL_MODE = """counts AS (SELECT source, lang, count(*) AS n FROM holes WHERE lang IS NOT NULL GROUP BY ALL),
learned AS (SELECT source, lang AS mode FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn
  FROM counts) WHERE rn = 1 AND n > 20)"""


@query("join_jn9_fill_from_map", f"""WITH {SQL_HOLES}, {SQL_MODE}
SELECT doc_id, coalesce(lang, mode, 'unknown_lang') AS lang FROM holes LEFT JOIN learned USING (source)""")
def fill_from_map(spark, sf):
    holes = _holes(spark, sf)
    learned = rel.mode_by_group(holes, "source", "lang", 20)
    return rel.fill_from_map(holes, learned, "source", "lang", ["doc_id"], "unknown_lang").select("doc_id", "lang")


@query("join_jn10_features_target", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def features_target(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("join_jn11_scalar", """
SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) + 0 AS delta FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)""")
def scalar(spark, sf):
    orders = table(spark, sf, "orders")
    mean = table(spark, sf, "orders").agg(F.avg("o_totalprice")).scalar()
    return orders.filter(F.col("o_totalprice") > mean).select(
        "o_orderkey", rounded(F.col("o_totalprice") - mean, 4).alias("delta"))


@query("join_jn12_relevant_found", f"""WITH {QRELS} SELECT query_id, doc_id, rank FROM flags WHERE hit = 1""")
def relevant_found(spark, sf):
    results = rt.search_bm25(fx.queries(spark, sf), fx.body_index(spark, sf))
    return results.join(fx.relevant(spark, sf), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "rank")


# ---- aggregates ---------------------------------------------------------------------

@query("aggregate_ag1_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM documents")
def count(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("aggregate_ag2_mean", f"WITH {BODY0} SELECT round(avgdl, 6) AS avgdl, CAST((SELECT sum(dl) FROM body_dl) AS BIGINT) AS total FROM body_stat")
def mean(spark, sf):
    return fx.body_index(spark, sf).doc_lengths.agg(
        rounded(F.coalesce(F.avg("dl"), F.lit(0.0))).alias("avgdl"), F.sum("dl").alias("total"))


@query("aggregate_ag3_posting_lists", f"""WITH {BODY50}
SELECT p.term, CAST(p.doc_id // 65536 AS BIGINT) AS block, string_agg(p.doc_id || ':' || p.tf, ' ' ORDER BY p.doc_id) AS postings
FROM body_post p JOIN body_terms USING (term) GROUP BY p.term, block""")
def posting_lists(spark, sf):
    blocks = ix.posting_blocks(fx.body_index(spark, sf, 50).kept_postings())
    shown = F.transform("postings", lambda p: F.concat(p["doc_id"].cast("string"), F.lit(":"), p["tf"].cast("string")))
    return blocks.select("term", "block", F.array_join(shown, " ").alias("postings"))


@query("aggregate_ag3_posting_lists_by_rows", f"""WITH {ANCHOR0},
placed AS (SELECT term, doc_id, tf, (row_number() OVER (PARTITION BY term ORDER BY doc_id, tf) - 1) // 20 AS block FROM anchor_post)
SELECT term, CAST(block AS BIGINT) AS block, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id, tf) AS postings FROM placed GROUP BY term, block""")
def posting_lists_by_rows(spark, sf):
    """Anchor postings repeat a document, so lists are cut by rows."""
    lists = ix.posting_lists(fx.anchor_index(spark, sf).postings, rows=20)
    shown = F.transform("postings", lambda p: F.concat(p["doc_id"].cast("string"), F.lit(":"), p["tf"].cast("string")))
    return lists.select("term", "block", F.array_join(shown, " ").alias("postings"))


@query("aggregate_ag4_document_frequency", f"WITH {BODY0} SELECT term, df FROM body_terms")
def document_frequency(spark, sf):
    return fx.body_index(spark, sf).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("aggregate_ag5_term_total", f"WITH {BODY0} SELECT term, term_total FROM body_terms")
def term_total(spark, sf):
    return fx.body_index(spark, sf).postings.groupBy("term").agg(F.sum("tf").alias("term_total"))


@query("aggregate_ag6_group_sum", "SELECT user_id AS id, round(sum(value), 4) + 0 AS total FROM events GROUP BY user_id")
def group_sum(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(rounded(F.sum("value"), 4).alias("total"))


@query("aggregate_ag7_score_sum", f"""WITH {BODY0}, {SQL_QUERY_TERMS}
SELECT query_id, doc_id, round(sum(ln(1 + tf) * qtf), 6) + 0 AS score FROM qterms JOIN body_post USING (term) GROUP BY ALL""")
def score_sum(spark, sf):
    found = rt.matches(rt.query_terms(fx.queries(spark, sf)), fx.body_index(spark, sf))
    return found.groupBy("query_id", "doc_id").agg(rounded(F.sum(F.log1p("tf") * F.col("qtf"))).alias("score"))


@query("aggregate_ag8_query_max", f"""WITH {TITLE0}, {SQL_QUERY_TERMS}, {COVER.format(b='title')}
SELECT query_id, doc_id, score, max(score) OVER (PARTITION BY query_id) AS top FROM title_hits""")
def query_max(spark, sf):
    scores = rt.coverage(rt.query_terms(fx.queries(spark, sf)), fx.title_index(spark, sf))
    return attach_stats(scores, ["query_id"], ["doc_id"], top=F.max("score"))


@query("aggregate_ag9_group_mean", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) + 0 AS mean, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def group_mean(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        rounded(F.avg("o_totalprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("aggregate_ag10_distinct", f"""WITH {SQL_GAPS}
SELECT 'price' AS "column", CAST(count(DISTINCT price) AS BIGINT) AS n_unique FROM gaps UNION ALL
SELECT 'priority', count(DISTINCT priority) FROM gaps UNION ALL SELECT 'status', count(DISTINCT status) FROM gaps""")
def distinct(spark, sf):
    return rel.distinct_counts(gaps(spark, sf), ["price", "priority", "status"])


@query("aggregate_ag11_value_counts", """
SELECT event_type AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def value_counts(spark, sf):
    return rel.value_counts(table(spark, sf, "events"), "event_type")


@query("aggregate_ag12_quantiles", f"""WITH {SQL_GAPS}
""" + " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS p, round(quantile_cont(price, {p}), 6) + 0 AS value FROM gaps" for p in (0.02, 0.25, 0.5, 0.75, 0.99)))
def quantiles(spark, sf):
    probs = [0.02, 0.25, 0.5, 0.75, 0.99]
    found = exact_quantiles(gaps(spark, sf), {"price": probs})["price"]
    return spark.createDataFrame(list(zip(probs, found)), "p double, value double").select("p", rounded(F.col("value")).alias("value"))


@query("aggregate_ag12_quantiles_narrowed", " UNION ALL ".join(
    f"SELECT '{c}' AS name, {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) + 0 AS value FROM lineitem"
    for c in ("l_quantity", "l_extendedprice") for p in (0.0, 0.02, 0.5, 0.99, 1.0)))
def quantiles_narrowed(spark, sf):
    """A column of few values and one of many, where no more than 30 rows may be sorted together."""
    probs = [0.0, 0.02, 0.5, 0.99, 1.0]
    found = exact_quantiles(table(spark, sf, "lineitem"), {"l_quantity": probs, "l_extendedprice": probs}, interval_rows=30)
    rows = [(c, p, v) for c, values in found.items() for p, v in zip(probs, values)]
    return spark.createDataFrame(rows, "name string, p double, value double").withColumn("value", rounded(F.col("value")))


@query("aggregate_ag13_mode", f"WITH {SQL_HOLES}, {SQL_MODE} SELECT source, mode AS lang FROM learned")
def mode(spark, sf):
    return rel.mode_by_group(_holes(spark, sf), "source", "lang", 20)


@query("aggregate_ag14_min_max", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'F'")
def min_max(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), rounded(F.avg("o_totalprice"), 4).alias("mean"))


@query("aggregate_ag15_axis_mean", """
SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])) / 64, 6) + 0 AS mean FROM embeddings""")
def axis_mean(spark, sf):
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", rounded(total / F.size("embedding")).alias("mean"))


@query("aggregate_ag15_feature_mean", """
SELECT CAST(i AS INTEGER) AS pos, round(avg(abs(CAST(embedding[i + 1] AS DOUBLE))), 6) + 0 AS mean FROM embeddings, range(64) r(i) GROUP BY i""")
def feature_mean(spark, sf):
    cells = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return cells.groupBy("pos").agg(rounded(F.avg(F.abs(F.col("x").cast("double")))).alias("mean"))


# ---- order and selection ------------------------------------------------------------

@query("topk_tk1_sort", "SELECT c_custkey AS id, c_name AS title FROM customer ORDER BY 1")
def sort(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")).sort("id")


@query("topk_tk2_top_k", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def top(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("topk_tk2_top_k_single", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_single(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("topk_tk3_full_ranking", f"""WITH {ANCHOR0}, {SQL_QUERY_TERMS}, {COVER.format(b='anchor')}
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM anchor_hits""")
def full_ranking(spark, sf):
    return rt.search_anchor(fx.queries(spark, sf), fx.anchor_index(spark, sf)).select("query_id", "doc_id", "rank")


SQL_DEV = """m AS (SELECT avg(o_totalprice) AS g FROM orders),
dev AS (SELECT o_orderpriority AS a, o_orderstatus AS b, avg(o_totalprice) - any_value(g) AS delta FROM orders, m GROUP BY ALL)"""


@query("topk_tk4_largest_deviation", f"""WITH {SQL_DEV}
SELECT a, b, round(delta, 4) + 0 AS delta FROM dev ORDER BY abs(delta) DESC LIMIT 3""")
def largest_deviation(spark, sf):
    orders = table(spark, sf, "orders")
    mean = table(spark, sf, "orders").agg(F.avg("o_totalprice")).scalar()
    means = orders.groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.avg("o_totalprice").alias("m"))
    dev = means.select("a", "b", (F.col("m") - mean).alias("delta"))
    return dev.orderBy(F.desc(F.abs("delta"))).limit(3).withColumn("delta", rounded(F.col("delta"), 4))


@query("topk_tk5_most_confident", """
SELECT vec_id, label FROM embeddings ORDER BY list_max(embedding) DESC, vec_id LIMIT 1000""")
def most_confident(spark, sf):
    return table(spark, sf, "embeddings").orderBy(F.desc(F.array_max("embedding")), "vec_id").limit(1000).select("vec_id", "label")


@query("topk_tk6_largest_magnitude", """
SELECT CAST(i AS INTEGER) AS pos, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) + 0 AS mean
FROM embeddings, range(64) r(i) GROUP BY i ORDER BY abs(avg(CAST(embedding[i + 1] AS DOUBLE))) DESC LIMIT 5""")
def largest_magnitude(spark, sf):
    cells = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.orderBy(F.desc(F.abs("mean"))).limit(5).withColumn("mean", rounded(F.col("mean")))


@query("topk_tk7_argmax", """
SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS argmax,
       (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS argmin""")
def argmax(spark, sf):
    return rel.extremes(table(spark, sf, "orders"), "o_totalprice", "o_orderkey")


@query("topk_tk8_first_per_class", """
SELECT label, vec_id, x FROM (SELECT label, vec_id, embedding[1] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn
  FROM embeddings) WHERE rn = 1""")
def first_per_class(spark, sf):
    vecs = table(spark, sf, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).alias("x"))
    return rel.first_per_class(vecs, "label", "vec_id", ["x"])


@query("topk_tk9_running_precision", f"""WITH {QRELS}
SELECT query_id, rank, round(sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank, 6) AS precision FROM flags WHERE rank <= 40""")
def running_precision(spark, sf):
    results = rt.search_bm25(fx.queries(spark, sf), fx.body_index(spark, sf))
    found = ireval.running_precision(results, fx.relevant(spark, sf))
    return found.select("query_id", "rank", rounded(F.col("precision")).alias("precision"))


# ---- set operations -----------------------------------------------------------------

@query("sets_st1_union_distinct", """
SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders UNION SELECT doc_id FROM labels""")
def union_distinct(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    ids = ids.union(table(spark, sf, "orders").select("o_custkey")).union(table(spark, sf, "labels").select("doc_id"))
    return ids.distinct()


@query("sets_st2_distinct_pairs", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).dropDuplicates(["src", "dst"])


@query("sets_st3_merge_scores", f"""WITH {TITLE0}, {ANCHOR0}, {SQL_QUERY_TERMS}, {COVER.format(b='title')}, {COVER.format(b='anchor')}
SELECT query_id, doc_id, round(sum(s), 6) + 0 AS score FROM (SELECT query_id, doc_id, 0.4::DOUBLE * score AS s FROM title_hits UNION ALL
  SELECT query_id, doc_id, 0.2::DOUBLE * score FROM anchor_hits) GROUP BY ALL""")
def merge_scores(spark, sf):
    terms = rt.query_terms(fx.queries(spark, sf))
    merged = rt.fuse([(rt.coverage(terms, fx.title_index(spark, sf)), 0.4), (rt.coverage(terms, fx.anchor_index(spark, sf)), 0.2)])
    return merged.withColumn("score", rounded(F.col("score")))


@query("sets_st4_append", """
SELECT doc_id, quality, 'labelled' AS origin FROM labels UNION ALL
SELECT doc_id, CAST(n_chars > 500 AS INTEGER), 'guessed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def append(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality", F.lit("labelled").alias("origin"))
    rest = table(spark, sf, "documents").join(labels, "doc_id", "left_anti")
    guessed = rest.select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit("guessed").alias("origin"))
    return labels.unionByName(guessed)


@query("sets_st6_stop_word_union", f"""WITH {sql_tokens('tok', 'documents', 'doc_id', 'text', stop=False)}
SELECT term, CAST(count(*) AS BIGINT) AS n FROM tok WHERE term IN {SQL_STOP} GROUP BY term""")
def stop_word_union(spark, sf):
    both = F.array_union(F.array(*map(F.lit, text.english_stop_words())), F.array(*map(F.lit, text.CORPUS_STOP_WORDS)))
    docs = fx.spread(table(spark, sf, "documents"))
    words = docs.select(text.unnest(text.raw_tokens(F.col("text"))).alias("term"))
    stop = spark.range(1).select(F.explode(both).alias("term"))  # 200 words
    return words.join(F.broadcast(stop), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
