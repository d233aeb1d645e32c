"""Time the headline queries; print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. The data
set is read once before timing, so times are for a warm JVM and a cold plan.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from corpuslab.catalog import QUERIES, fixtures as fx
from corpuslab.catalog.registry import table
from corpuslab.operators import index as ix
from corpuslab.session import local_session

HEADLINE = (
    "retrieve_rt1_tfidf", "retrieve_rt2_bm25", "retrieve_rt9_search", "ireval_ev6_evaluate", "index_ix4_doc_norms",
    "graph_gr3_pagerank", "graph_gr6_reachability", "features_fe8_tfidf", "features_fe9_topics", "profile_pr3_describe",
    "profile_pr6_binned_mean", "models_ml1_naive_bayes", "models_ml9_lasso", "explain_xp2_tree", "grid_gd2_put",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    for name in ("documents", "lineitem"):
        drain(table(spark, sf_dir, name))
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.count()
    n_chars = docs.agg(F.sum("n_chars")).first()[0]
    # inputs of the queries below, built once like the tables of a running search engine
    timed("index_build_body", lambda: fx.body_index(spark, sf_dir))
    timed("index_build_title", lambda: fx.title_index(spark, sf_dir))
    timed("index_build_anchor", lambda: fx.anchor_index(spark, sf_dir))
    timed("graph_link_ranks", lambda: fx.link_ranks(spark, sf_dir))
    fx.body_index(spark, sf_dir, 50)
    # the same build again, now that the code paths are compiled
    timed("index_build_body_warm", lambda: ix.build_index(docs, "doc_id", "text", 0))
    for name in HEADLINE:
        timed(name, lambda: drain(QUERIES[name](spark, sf_dir)))
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None, "cpus": int(cpus),
        "documents": n_docs, "characters": int(n_chars),
    }))


if __name__ == "__main__":
    main()
