"""Registered queries for index building, retrieval and ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.catalog import fixtures as fx
from corpuslab.catalog.fixtures import SQL_LINK_LISTS, SQL_LINKS, SQL_QUERY_TERMS, SQL_TITLES, SQL_VIEWS, sql_postings
from corpuslab.catalog.registry import query, table
from corpuslab.functions.scalar import rounded
from corpuslab.operators import blockmax, index as ix, ireval, retrieve as rt
from corpuslab.plans.ranking import top_k
from corpuslab.plans.storage import new_path, written
from corpuslab.sources import index_store

BODY0 = sql_postings("body", "documents", "doc_id", "text", 0)
BODY50 = sql_postings("body", "documents", "doc_id", "text", 50)
TITLE0 = SQL_TITLES + ",\n" + sql_postings("title", "titles", "id", "title", 0)
ANCHOR_ROWS = SQL_LINKS + ",\nanchors AS (SELECT dst AS id, text FROM links WHERE text <> '')"
ANCHOR0 = ANCHOR_ROWS + ",\n" + sql_postings("anchor", "anchors", "id", "text", 0)


# Scores carry 9 digits. Showing 6 would round exact halves, on which engines differ,
# so both sides add a little first.
SHOWN = "round(score + 1e-10, 6) + 0 AS score"


def shown(score="score"):
    return rounded(F.col(score) + F.lit(1e-10))


# ---- index ------------------------------------------------------------------------

@query("index_ix1_postings", f"""WITH {BODY50}
SELECT p.term, p.doc_id, p.tf FROM body_post p JOIN body_terms USING (term)""")
def postings(spark, sf):
    return fx.body_index(spark, sf, 50).kept_postings().select("term", "doc_id", "tf")


@query("index_ix2_term_stats", f"WITH {BODY50} SELECT term, df, term_total FROM body_terms")
def term_stats(spark, sf):
    return fx.body_index(spark, sf, 50).terms


@query("index_ix3_doc_lengths", f"""WITH {BODY50}
SELECT id, dl, round(avgdl, 6) AS avgdl FROM body_dl, body_stat""")
def doc_lengths(spark, sf):
    index = fx.body_index(spark, sf, 50)
    return index.doc_lengths.withColumn("avgdl", rounded(F.lit(index.avgdl)))


NORMS = """{b}_norm AS (SELECT doc_id AS id, sqrt(sum(pow((1 + ln(tf)) * ln(n / df), 2))) AS norm
  FROM {b}_post JOIN {b}_terms USING (term), {b}_stat GROUP BY doc_id)"""


@query("index_ix4_doc_norms", f"WITH {BODY50}, {NORMS.format(b='body')} SELECT id, round(norm, 6) + 0 AS norm FROM body_norm")
def doc_norms(spark, sf):
    return ix.doc_norms(fx.body_index(spark, sf, 50)).select("id", rounded(F.col("norm")).alias("norm"))


@query("index_ix5_title_index", f"""WITH {TITLE0}
SELECT p.term, p.doc_id, p.tf, t.df FROM title_post p JOIN title_terms t USING (term)""")
def title_index(spark, sf):
    return fx.title_index(spark, sf).kept_postings().select("term", "doc_id", "tf", "df")


@query("index_ix6_anchor_index", f"""WITH {ANCHOR0}
SELECT p.term, p.doc_id, p.tf, t.df FROM anchor_post p JOIN anchor_terms t USING (term)""")
def anchor_index(spark, sf):
    return fx.anchor_index(spark, sf).kept_postings().select("term", "doc_id", "tf", "df")


@query("index_ix7_add_documents", f"WITH {BODY0} SELECT term, df, term_total FROM body_terms")
def add_documents(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id")
    old = ix.build_index(docs.join(labels, "doc_id", "left_semi"), "doc_id", "text", 0)
    return ix.add_documents(old, docs.join(labels, "doc_id", "left_anti"), "doc_id", "text").terms


@query("index_ix7_add_to_stored", f"WITH {BODY0} SELECT term, df, term_total FROM body_terms")
def add_to_stored(spark, sf):
    """An index written with 16 buckets, read again and extended."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id")
    path = new_path(spark, "index")
    index_store.write_index(ix.build_index(docs.join(labels, "doc_id", "left_semi"), "doc_id", "text", 0), path, buckets=16)
    grown = ix.add_documents(index_store.read_index(spark, path), docs.join(labels, "doc_id", "left_anti"), "doc_id", "text")
    return ix.term_stats(grown.postings, 0)


@query("index_ix8_popularity", f"WITH {SQL_VIEWS} SELECT id, views FROM views")
def popularity(spark, sf):
    return fx.views(spark, sf)


# ---- single signals ----------------------------------------------------------------

@query("retrieve_rt1_tfidf", f"""WITH {BODY50}, {NORMS.format(b='body')}, {SQL_QUERY_TERMS},
known AS (SELECT query_id, term, df, (1 + ln(qtf)) * ln(n / df) AS qw, ln(n / df) AS idf
  FROM qterms JOIN body_terms USING (term), body_stat),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS q_norm FROM known GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum((1 + ln(tf)) * idf * qw) AS dot FROM known JOIN body_post USING (term) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(dot / (norm * q_norm), 9) AS score FROM dots JOIN qn USING (query_id)
  JOIN body_norm ON id = doc_id WHERE norm > 0 AND q_norm > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, doc_id, {SHOWN}, rank FROM ranked WHERE rank <= 100""")
def tfidf(spark, sf):
    found = rt.search_tfidf(fx.queries(spark, sf), fx.body_index(spark, sf, 50))
    return found.withColumn("score", shown())


BM25 = f"""{BODY0}, {SQL_QUERY_TERMS},
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2)
    / (tf + 1.2 * (1 - 0.75 + 0.75 * (coalesce(nullif(dl, 0), floor(avgdl)) / avgdl)))), 9) AS score
  FROM qterms JOIN body_terms USING (term) JOIN body_post USING (term) JOIN body_dl USING (row_no), body_stat
  GROUP BY query_id, doc_id),
body_hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM bm) WHERE rank <= 1000)"""


@query("retrieve_rt2_bm25", f"WITH {BM25} SELECT query_id, doc_id, {SHOWN}, rank FROM body_hits")
def bm25(spark, sf):
    found = rt.search_bm25(fx.queries(spark, sf), fx.body_index(spark, sf))
    return found.withColumn("score", shown())


@query("retrieve_rt2_bm25_pruned", f"WITH {BM25} SELECT query_id, doc_id, {SHOWN}, rank FROM body_hits")
def bm25_pruned(spark, sf):
    """The same rows from the block-maximum index."""
    return blockmax.search_bm25(fx.queries(spark, sf), fx.body_blocks(spark, sf)).hits.withColumn("score", shown())


@query("retrieve_rt2_bm25_top10_pruned", f"WITH {BM25} SELECT query_id, doc_id, {SHOWN}, rank FROM body_hits WHERE rank <= 10")
def bm25_top10_pruned(spark, sf):
    return blockmax.search_bm25(fx.queries(spark, sf), fx.body_blocks(spark, sf), k=10).hits.withColumn("score", shown())


@query("retrieve_rt2_pruning")
def pruning(spark, sf):
    """Postings of each query's terms, and those that a search for ten documents reads."""
    return blockmax.search_bm25(fx.queries(spark, sf), fx.body_blocks(spark, sf), k=10).report


COVER = """{b}_hits AS (SELECT query_id, doc_id, CAST(count(*) AS BIGINT) AS score FROM qterms JOIN {b}_post USING (term)
  GROUP BY query_id, doc_id)"""
RANKED = """SELECT query_id, doc_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM """


@query("retrieve_rt3_title", f"WITH {TITLE0}, {SQL_QUERY_TERMS}, {COVER.format(b='title')} {RANKED} title_hits")
def title(spark, sf):
    return rt.search_title(fx.queries(spark, sf), fx.title_index(spark, sf))


@query("retrieve_rt4_anchor", f"WITH {ANCHOR0}, {SQL_QUERY_TERMS}, {COVER.format(b='anchor')} {RANKED} anchor_hits")
def anchor(spark, sf):
    return rt.search_anchor(fx.queries(spark, sf), fx.anchor_index(spark, sf))


@query("retrieve_rt4_anchor_distinct", f"""WITH {ANCHOR0}, {SQL_QUERY_TERMS},
hits AS (SELECT query_id, doc_id, CAST(count(DISTINCT term) AS BIGINT) AS score FROM qterms JOIN anchor_post USING (term)
  GROUP BY query_id, doc_id) {RANKED} hits""")
def anchor_distinct(spark, sf):
    return rt.search_anchor(fx.queries(spark, sf), fx.anchor_index(spark, sf), mode="distinct")


# ---- fusion ------------------------------------------------------------------------

def _norm(b: str) -> str:
    return (f"{b}_norm1 AS (SELECT query_id, doc_id, score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1) AS score "
            f"FROM {b}_hits)")


SIGNALS = (f"{BM25}, {TITLE0}, {ANCHOR0}, {COVER.format(b='title')}, {COVER.format(b='anchor')}, "
           + ", ".join(_norm(b) for b in ("body", "title", "anchor")))
FUSED = f"""{SIGNALS}, fused AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM (
  SELECT query_id, doc_id, 0.40 * score AS s FROM body_norm1 UNION ALL
  SELECT query_id, doc_id, 0.40 * score FROM title_norm1 UNION ALL
  SELECT query_id, doc_id, 0.20 * score FROM anchor_norm1) GROUP BY query_id, doc_id)"""
POOL = f"""{FUSED}, pool AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM fused) WHERE rank <= 500)"""


def _pagerank_sql() -> str:
    from corpuslab.catalog.graph_queries import sql_pagerank

    return (f"""edges AS (SELECT DISTINCT page_id AS src, dst FROM pages JOIN links ON src = page_id),
verts AS (SELECT page_id AS id FROM pages UNION SELECT dst FROM links), """ + sql_pagerank("edges", "verts"))


def _boost_sql() -> str:
    return f"""{POOL}, {SQL_VIEWS}, {_pagerank_sql()},
signals AS (SELECT query_id, p.doc_id, score, ln(1 + coalesce(pagerank, 0)) AS pr, ln(1 + coalesce(views, 0)) AS pv
  FROM pool p LEFT JOIN pagerank r ON r.id = p.doc_id LEFT JOIN views v ON v.id = p.doc_id),
tops AS (SELECT query_id, max(pr) AS mpr, max(pv) AS mpv FROM signals GROUP BY query_id),
boosted AS (SELECT query_id, doc_id, round(score + 0.05 * pr / CASE WHEN mpr > 0 THEN mpr ELSE 1 END
  + 0.05 * pv / CASE WHEN mpv > 0 THEN mpv ELSE 1 END, 9) AS score FROM signals JOIN tops USING (query_id))"""


def _three(spark, sf):
    return fx.body_index(spark, sf), fx.title_index(spark, sf), fx.anchor_index(spark, sf)


def _pool(spark, sf):
    fused = rt.fused_scores(fx.queries(spark, sf), *_three(spark, sf))
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("doc_id")], rt.CANDIDATES)


@query("retrieve_rt5_normalize", f"WITH {SIGNALS} " + " UNION ALL ".join(
    f"SELECT '{b}' AS signal, query_id, doc_id, round(score, 6) + 0 AS score FROM {b}_norm1" for b in ("body", "title", "anchor")))
def normalize(spark, sf):
    body, title_ix, anchor_ix = _three(spark, sf)
    qs = fx.queries(spark, sf)
    terms = rt.query_terms(qs)
    parts = {
        "body": rt.search_bm25(qs, body),
        "title": rt.coverage(terms, title_ix),
        "anchor": rt.coverage(terms, anchor_ix),
    }
    out = [
        rt.max_normalize(s, terms.small, ranked=n == "body").select(F.lit(n).alias("signal"), "query_id", "doc_id", rounded(F.col("score")).alias("score"))
        for n, s in parts.items()
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("retrieve_rt6_fusion", f"WITH {FUSED} SELECT query_id, doc_id, {SHOWN} FROM fused")
def fusion(spark, sf):
    fused = rt.fused_scores(fx.queries(spark, sf), *_three(spark, sf))
    return fused.withColumn("score", shown())


@query("retrieve_rt7_candidates", f"WITH {POOL} SELECT query_id, doc_id, {SHOWN}, rank FROM pool")
def candidates(spark, sf):
    return _pool(spark, sf).withColumn("score", shown())


@query("retrieve_rt8_boost", f"WITH {_boost_sql()} SELECT query_id, doc_id, {SHOWN} FROM boosted")
def boost(spark, sf):
    pool = written(_pool(spark, sf).select("query_id", "doc_id", "score"), "candidates")
    found = rt.boost(pool, fx.link_ranks(spark, sf), fx.views(spark, sf))
    return found.withColumn("score", shown())


@query("retrieve_rt8_boost_large", f"WITH {_boost_sql()} SELECT query_id, doc_id, {SHOWN} FROM boosted")
def boost_large(spark, sf):
    """The popularity lookup of result tables too large to broadcast."""
    pool = written(_pool(spark, sf).select("query_id", "doc_id", "score"), "candidates")
    found = rt.boost(pool, fx.link_ranks(spark, sf), fx.views(spark, sf), max_rows=0)
    return found.withColumn("score", shown())


RT9 = f"""WITH {_boost_sql()},
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM boosted) WHERE rank <= 100)
SELECT query_id, rank, doc_id, title, {SHOWN} FROM best LEFT JOIN titles ON id = doc_id"""


@query("retrieve_rt9_search", RT9)
def search(spark, sf):
    found = rt.search(
        fx.queries(spark, sf), *_three(spark, sf), fx.link_ranks(spark, sf), fx.views(spark, sf), fx.titles(spark, sf))
    return found.withColumn("score", shown())


@query("retrieve_rt9_search_pruned", RT9)
def search_pruned(spark, sf):
    """The same rows with the body part from the block-maximum index."""
    hits = blockmax.search_bm25(fx.queries(spark, sf), fx.body_blocks(spark, sf)).hits
    found = rt.search(
        fx.queries(spark, sf), *_three(spark, sf), fx.link_ranks(spark, sf), fx.views(spark, sf), fx.titles(spark, sf), body_hits=hits)
    return found.withColumn("score", shown())


# ---- lookups -----------------------------------------------------------------------

def id_lists(spark, sf):
    """Link targets of each page, in order, as one request per page."""
    return fx.anchored_pages(spark, sf).select(
        F.col("id").alias("src"), F.transform("anchor_text", lambda a: a["id"]).alias("ids"))


def _lookup_sql(shown: str, source: str, prefix: str) -> str:
    return f"""WITH {SQL_LINKS}, {SQL_LINK_LISTS}, {prefix}
SELECT src, pos, dst AS id, {shown} FROM link_lists LEFT JOIN {source} s ON s.id = dst"""


@query("retrieve_rt10_pagerank_lookup", _lookup_sql(
    "round(coalesce(pagerank, 0.0), 6) + 0 AS pagerank", "pagerank", _pagerank_sql()))
def pagerank_lookup(spark, sf):
    return rt.lookup(id_lists(spark, sf), fx.link_ranks(spark, sf), "pagerank", 0.0).withColumn("pagerank", rounded(F.col("pagerank")))


@query("retrieve_rt11_views_lookup", _lookup_sql("coalesce(views, 0) AS views", "views", SQL_VIEWS))
def views_lookup(spark, sf):
    return rt.lookup(id_lists(spark, sf), fx.views(spark, sf), "views", 0)


@query("retrieve_rt12_unknown_queries", f"""WITH {BODY0},
odd AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE '?? ! zzzzqqqq' END AS text FROM benchmark),
{SQL_QUERY_TERMS.replace("FROM benchmark", "FROM odd")}
SELECT DISTINCT query_id FROM qterms JOIN body_terms USING (term)""")
def unknown_queries(spark, sf):
    which = F.col("query_id") % 3
    odd = fx.queries(spark, sf).withColumn(
        "text", F.when(which == 0, F.col("text")).when(which == 1, F.lit("")).otherwise(F.lit("?? ! zzzzqqqq")))
    return rt.search_bm25(odd, fx.body_index(spark, sf)).select("query_id").distinct()


# ---- ranking quality ---------------------------------------------------------------

QRELS = f"""{BM25},
longest AS (SELECT query_id, max({{'n': length(term), 'term': term}}).term AS term FROM qterms GROUP BY query_id),
qrels AS (SELECT DISTINCT query_id, doc_id FROM longest JOIN body_post USING (term)),
flags AS (SELECT h.query_id, h.doc_id, rank, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS hit
  FROM body_hits h LEFT JOIN qrels q ON q.query_id = h.query_id AND q.doc_id = h.doc_id),
base AS (SELECT item_id AS query_id FROM benchmark),
rel AS (SELECT query_id, count(*) AS m FROM qrels GROUP BY query_id)"""


def _pr(k: int) -> str:
    return f"""pr{k} AS (SELECT query_id, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE round_even(h / n, 3) END AS p,
  CASE WHEN coalesce(m, 0) = 0 THEN 1.0 ELSE round_even(coalesce(h, 0) / m, 3) END AS r
  FROM base LEFT JOIN (SELECT query_id, count(*) AS n, sum(hit) AS h FROM flags WHERE rank <= {k} GROUP BY query_id) USING (query_id)
  LEFT JOIN rel USING (query_id)),
f{k} AS (SELECT *, CASE WHEN p = 0 OR r = 0 THEN 0.0 ELSE round_even(2.0 / (1.0 / p + 1.0 / r), 3) END AS f FROM pr{k})"""


RUNNING = """run AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank AS prec FROM flags WHERE rank <= 40),
aps AS (SELECT base.query_id, coalesce(round_even(avg(prec), 3), 0.0) AS ap
  FROM base LEFT JOIN (SELECT * FROM run WHERE hit = 1) r ON r.query_id = base.query_id GROUP BY base.query_id)"""


def _judged(spark, sf):
    results = fx.once(spark, sf, "bm25-results", lambda: fx.written(
        rt.search_bm25(fx.queries(spark, sf), fx.body_index(spark, sf)), "results"))
    return results, fx.relevant(spark, sf), fx.queries(spark, sf)


@query("ireval_ev1_average_precision", f"WITH {QRELS}, {RUNNING} SELECT query_id, ap FROM aps")
def average_precision(spark, sf):
    return ireval.average_precision(*_judged(spark, sf))


@query("ireval_ev2_precision", f"WITH {QRELS}, {_pr(10)} SELECT query_id, p AS precision FROM pr10")
def precision(spark, sf):
    return ireval.precision_at_k(*_judged(spark, sf), 10)


@query("ireval_ev3_recall", f"WITH {QRELS}, {_pr(10)} SELECT query_id, r AS recall FROM pr10")
def recall(spark, sf):
    return ireval.recall_at_k(*_judged(spark, sf), 10)


@query("ireval_ev4_f1", f"WITH {QRELS}, {_pr(30)}, x AS (SELECT 1) SELECT query_id, f AS f1 FROM f30")
def f1(spark, sf):
    return ireval.f1_at_k(*_judged(spark, sf), 30)


QUALITY = """CASE WHEN f5.p = 0 OR f30.f = 0 THEN 0.0 ELSE round_even(2.0 / (1.0 / f5.p + 1.0 / f30.f), 3) END AS quality"""


@query("ireval_ev5_quality", f"WITH {QRELS}, {_pr(5)}, {_pr(30)} SELECT query_id, {QUALITY} FROM f5 JOIN f30 USING (query_id)")
def quality(spark, sf):
    return ireval.results_quality(*_judged(spark, sf))


@query("ireval_ev6_evaluate", f"""WITH {QRELS}, {_pr(5)}, {_pr(30)}, {RUNNING}
SELECT query_id, ap AS ap_at_40, f5.p AS p_at_5, f30.r AS r_at_30, f30.f AS f1_at_30, {QUALITY}
FROM f5 JOIN f30 USING (query_id) JOIN aps USING (query_id)""")
def evaluate(spark, sf):
    return ireval.evaluate(*_judged(spark, sf))
