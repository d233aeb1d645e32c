"""Inverted index over a document table: postings, terms, lengths, norms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpuslab.functions import text
from corpuslab.plans.ranking import group_places
from corpuslab.plans.skew import fits_broadcast, hot_keys, salted_join
from corpuslab.plans.storage import written
from corpuslab.sources.corpus import spread

MIN_POSTINGS = 50
POSTING_BLOCK = 65_536


@dataclass
class Index:
    """Frames of one index.

    postings: term, doc_id, tf, dl (document length kept beside each posting so
    that BM25 needs no join), and bucket when read from index files, where it
    names the folder. terms: term, df, term_total, for kept terms only.
    doc_lengths: id, dl, including documents without tokens.
    """

    postings: DataFrame
    terms: DataFrame
    doc_lengths: DataFrame
    n_docs: int
    avgdl: float
    # folders of the index files the postings come from, and the threshold the terms passed
    buckets: int | None = None
    min_postings: int = 0
    # (id, dl, counts) of the rows the postings come from, where they are at hand
    counted: DataFrame | None = None

    def kept_postings(self) -> DataFrame:
        """Postings of terms that passed the frequency threshold, with their df.

        Terms that are measured to be few travel to the postings, which stay where they are.
        """
        table = self.terms.select("term", "df")
        if fits_broadcast(table):
            return self.postings.join(F.broadcast(table), "term")
        hot = hot_keys(self.terms, ["term"], "df")
        if hot.isEmpty():
            return self.postings.join(table, "term")
        return salted_join(self.postings, table, ["term"], hot, ["doc_id"])


def doc_terms(
    df: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """(id, dl, counts) per input row, counted in the row without a shuffle."""
    tokens = df.select(
        F.col(id_col).cast("long").alias("id"), *extra, text.tokenize(F.col(text_col), stop_words).alias("tokens")
    )
    return text.count_in_row(tokens.withColumn("dl", F.size("tokens")), "tokens").select("id", *extra, "dl", "counts")


def postings_of(counted: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl), one row per distinct term of each counted row."""
    return counted.select("id", "dl", F.explode("counts").alias("c")).select(
        F.col("c.term").alias("term"), F.col("id").alias("doc_id"), F.col("c.tf").alias("tf"), "dl"
    )


def term_stats(postings: DataFrame, min_postings: int = MIN_POSTINGS) -> DataFrame:
    """(term, df, term_total) of terms with more than ``min_postings`` postings.

    df counts postings, so a document that occurs twice in a list counts twice.
    """
    return (
        postings.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("term_total"))
        .filter(F.col("df") > min_postings)
    )


def build_index(
    df: DataFrame,
    id_col: str,
    text_col: str,
    min_postings: int = MIN_POSTINGS,
    stop_words: tuple[str, ...] | None = None,
) -> Index:
    """Tokenise every row once, keep the counts in the shared folder, derive the rest from them."""
    counted = written(doc_terms(spread(df), id_col, text_col, stop_words), "doc-terms")
    return _index_of(counted, min_postings)


def _index_of(counted: DataFrame, min_postings: int) -> Index:
    lengths = counted.select("id", "dl")
    n_docs, avgdl = lengths.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    postings = postings_of(counted)
    terms = written(term_stats(postings, min_postings), "terms")
    return Index(postings, terms, lengths, n_docs, avgdl, min_postings=min_postings, counted=counted)


def anchor_rows(df: DataFrame, anchors_col: str) -> DataFrame:
    """(id, text) for each usable anchor: target id present and text not empty."""
    usable = F.filter(F.col(anchors_col), lambda a: (F.coalesce(a["text"], F.lit("")) != "") & a["id"].isNotNull())
    return df.select(F.explode_outer(usable).alias("a")).filter("a IS NOT NULL").select("a.id", "a.text")


def build_anchor_index(
    df: DataFrame, anchors_col: str, min_postings: int = MIN_POSTINGS, stop_words: tuple[str, ...] | None = None
) -> Index:
    """Index of link texts under the page they point to, one posting per link and term."""
    return build_index(anchor_rows(df, anchors_col), "id", "text", min_postings, stop_words)


def add_documents(
    index: Index, df: DataFrame, id_col: str, text_col: str, min_postings: int = 0,
    stop_words: tuple[str, ...] | None = None,
) -> Index:
    """Append the postings of new documents and bring the term totals up to date.

    Old totals are added to new ones; the old postings are not read again. The old
    index must have been built with ``min_postings=0``, or dropped terms would miss
    their earlier postings; another one is refused.
    """
    if index.min_postings:
        raise ValueError(f"the index lacks the postings of terms with up to {index.min_postings} of them")
    counted = written(doc_terms(spread(df), id_col, text_col, stop_words), "doc-terms")
    fresh = _index_of(counted, 0)
    terms = (
        index.terms.unionByName(fresh.terms)
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("term_total").alias("term_total"))
        .filter(F.col("df") > min_postings)
    )
    n = index.n_docs + fresh.n_docs
    avgdl = (index.avgdl * index.n_docs + fresh.avgdl * fresh.n_docs) / n if n else 0.0
    return Index(
        index.postings.select("term", "doc_id", "tf", "dl").unionByName(fresh.postings), terms,
        index.doc_lengths.unionByName(fresh.doc_lengths), n, avgdl, min_postings=min_postings,
    )


def doc_norms(index: Index) -> DataFrame:
    """(id, norm): length of each document's tf-idf vector over kept terms."""
    weight = (1 + F.log("tf")) * F.log(F.lit(float(index.n_docs)) / F.col("df"))
    return (
        index.kept_postings()
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    )


def posting_blocks(postings: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """Posting lists as arrays sorted by doc_id, cut into id ranges.

    (term, block, postings). A list never spans more than ``block`` ids, so the
    list of a term that occurs in every document does not end up in one row.
    """
    return postings.groupBy("term", F.floor(F.col("doc_id") / block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings")
    )


def posting_lists(postings: DataFrame, rows: int = POSTING_BLOCK) -> DataFrame:
    """Posting lists as arrays sorted by (doc_id, tf), cut after every ``rows`` postings of a term.

    (term, block, postings). Suits indexes in which a document may occur very often under a
    term, as a page under the texts of its links, where ranges of ids bound nothing.
    """
    placed = group_places(postings.select("term", "doc_id", "tf"), ["term"], [F.asc("doc_id"), F.asc("tf")])
    return placed.groupBy("term", F.floor((F.col("place") - 1) / rows).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def popularity(views: DataFrame) -> DataFrame:
    """(id, views) summed per id."""
    return views.groupBy("id").agg(F.sum("views").alias("views"))
