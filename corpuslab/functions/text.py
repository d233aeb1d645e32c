"""Text expressions: tokens, stop words, in-row term counts, last word.

Columns here are built from Spark's own functions and run inside the JVM; terms are counted
on Arrow batches. Nothing needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The token rule of the search engine. 3 to 25 word characters,
# inner apostrophes or hyphens allowed, an optional leading # or @.
TOKEN_PATTERN = r"[#@\p{L}\p{N}_](?:['\-]?[\p{L}\p{N}_]){2,24}"

# The same tokens: a repetition never has to give a character back, as none of its parts can match a ' or -
# in two ways. Java then repeats in a loop, without keeping places to return to.
_TOKEN_PATTERN_JAVA = TOKEN_PATTERN + "+"

# A word is a run of letters and digits, without underscores.
WORD_PATTERN = r"[\p{L}\p{N}]+"

# Words too common in this kind of corpus to be worth indexing.
CORPUS_STOP_WORDS = (
    "category", "references", "also", "external", "links",
    "may", "first", "see", "history", "people", "one", "two",
    "part", "thumb", "including", "second", "following",
    "many", "however", "would", "became",
)

ENGLISH_LIST = Path(__file__).resolve().parent.parent / "data" / "english_stop_words.txt"


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    return tuple(w.strip() for w in ENGLISH_LIST.read_text(encoding="utf-8").splitlines() if w.strip())


@lru_cache(maxsize=1)
def all_stop_words() -> tuple[str, ...]:
    """Sorted union of the English list and the corpus list."""
    return tuple(sorted({*english_stop_words(), *CORPUS_STOP_WORDS}))


def raw_tokens(text: Column) -> Column:
    """Lower-cased tokens in text order, stop words included. NULL text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN_PATTERN_JAVA), F.lit(0))


def tokenize(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Tokens without stop words. ``stop_words=()`` keeps every token."""
    stop = all_stop_words() if stop_words is None else stop_words
    tokens = raw_tokens(text)
    if not stop:
        return tokens
    # isin over literals becomes a hash-set probe, not a scan of the list.
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def token_count(tokens: Column) -> Column:
    return F.size(tokens)


def query_length(tokens: Column) -> Column:
    """Number of distinct tokens, at least 1."""
    return F.greatest(F.size(F.array_distinct(tokens)), F.lit(1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def last_token(text: Column) -> Column:
    """Last word of the text in lower case, '' when there is none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    return F.lower(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))


def join_texts(*parts: Column) -> Column:
    """Concatenate with single spaces; NULL counts as an empty string."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def bucket_of(term: Column, buckets: int = 124) -> Column:
    """Storage bucket of a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def count_in_row(df: DataFrame, tokens: str, out: str = "counts") -> DataFrame:
    """Replace ``tokens`` by ``out``: array<struct<term, tf>> counted inside each row, terms in order of their bytes.

    A row holds all tokens of its document, so counting needs no shuffle. The tokens of a batch of
    rows are counted together. A missing array stays missing.
    """
    others = [c for c in df.columns if c != tokens]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(tokens)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            width = max(1, len(order))
            place = np.empty(len(order), dtype=np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            # one number per token, ordered by row and term
            keys = np.repeat(np.arange(len(lists), dtype=np.int64) * width, sizes) + place[coded.indices.to_numpy()]
            keys.sort()
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            tf = np.diff(starts, append=len(keys)).astype(np.int32)
            keys = keys[starts]
            terms = coded.dictionary.take(order).take(pa.array(keys % width))
            ends = np.searchsorted(keys, np.arange(len(lists) + 1, dtype=np.int64) * width).astype(np.int32)
            entries = pa.StructArray.from_arrays([terms, pa.array(tf)], ["term", "tf"])
            counts = pa.ListArray.from_arrays(pa.array(ends), entries, mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), counts], [*others, out])

    entry = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(out, T.ArrayType(entry))])
    return df.select(*others, tokens).mapInArrow(count, schema)


def unnest(array: Column) -> Column:
    """Explode an expensive array expression.

    A plain explode() makes Catalyst add a ``size(array) > 0`` filter below it,
    which evaluates the whole expression twice; the outer form does not. Filter
    the NULL element that an empty array leaves behind.
    """
    return F.explode_outer(array)


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """(id, term, tf) for each row; one row per distinct term of each input row."""
    tokens = df.select(F.col(id_col).alias("id"), tokenize(F.col(text_col), stop_words).alias("tokens"))
    return (
        count_in_row(tokens, "tokens")
        .select("id", unnest(F.col("counts")).alias("c"))
        .filter("c IS NOT NULL")
        .select("id", F.col("c.term").alias("term"), F.col("c.tf").alias("tf"))
    )
