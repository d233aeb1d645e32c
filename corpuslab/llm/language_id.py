"""Language ID by rank-order profiles of character n-grams.

A text's letters, in lower case and with one space around each word, give n-grams of one
to three characters that do not cross a word's end. The most frequent ones in order are
its profile. A text belongs to the language from whose profile its own is least out of
place: each n-gram adds the difference of its ranks, or the profile length if it is
missing there.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpuslab.llm.common import map_text, quoted

# Ranks compared, and documents per language that the profiles are learned from.
PROFILE = 400
SAMPLE_PER_LANG = 2000
UNKNOWN = "und"
LETTER_BITS = 21


def letter_table() -> np.ndarray:
    """1 for every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)


def grams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of the text; empty if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    padded = np.zeros(len(codes) + 2, np.int64)
    padded[1:-1] = np.where(is_letter, codes, 0)
    filled = padded != 0
    # one zero between words
    c = padded[filled | np.concatenate([[True], filled[:-1]])]
    if c[-1]:
        c = np.append(c, 0)
    if not c[0] and len(c) > 1 and not c[1]:
        c = c[1:]
    pairs = (c[:-1] << LETTER_BITS) | c[1:]
    triples = (pairs[:-1] << LETTER_BITS) | c[2:]
    return np.concatenate([c[c != 0], pairs, triples[c[1:-1] != 0]])


def profile(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order; of equally frequent ones the smaller first."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > size:
        least = np.partition(counts, -size)[-size]
        kept = counts >= least
        values, counts = values[kept], counts[kept]
    return values[np.argsort(-counts, kind="stable")][:size]


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
    sample: int = SAMPLE_PER_LANG, size: int = PROFILE,
) -> dict[str, list[int]]:
    """Profiles {language: codes in order} from at most ``sample`` documents of each language.

    The documents are those with the smallest hash of the id, null languages left out.
    Their n-grams are counted where the texts are, and only ``size`` counts for each
    language come to the driver.
    """
    labelled = docs.filter(F.col(quoted(lang)).isNotNull()).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(lang)).alias("lang"))
    place = F.xxhash64(F.lit("sample"), "id")
    order = Window.partitionBy("lang").orderBy(place, "id")
    chosen = labelled.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    last = chosen.groupBy("lang").agg(F.max(place).alias("last"))
    given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(lang)).alias("lang"), F.col(quoted(text)).alias("text"))
    # one row per language
    part = given.join(F.broadcast(last), "lang").filter(place <= F.col("last"))

    def run(batches):
        import pyarrow as pa

        letters = letter_table()
        found: dict[str, list[np.ndarray]] = {}
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(name):
            values, n = np.unique(np.concatenate(found.pop(name)), return_counts=True)
            if name in counts:
                values, inverse = np.unique(np.concatenate([values, counts[name][0]]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([n, counts[name][1]]), len(values)).astype(np.int64)
            counts[name] = values, n

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(name, []).append(grams(t, letters))
                if len(found[name]) == 64:
                    fold(name)
        for name in list(found):
            fold(name)
        for name, (values, n) in counts.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(values), pa.string()), "gram": pa.array(values, pa.int64()), "n": pa.array(n, pa.int64())})

    counted = part.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def out_of_place(own: np.ndarray, known: np.ndarray, ranks: np.ndarray, size: int) -> int:
    """Sum of rank differences; ``known`` is sorted and ``ranks`` has the ranks."""
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    found = known[at] == own
    return int(np.where(found, np.abs(ranks[at] - np.arange(len(own))), size).sum())


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """Add ``lang_pred`` and ``score``.

    The score is one minus the distance over the largest possible one. A text that is null
    or has no letter, or any text when no language was learned, is ``und`` with score 0. Of
    equally close languages the first in order of name wins.
    """
    names = sorted(profiles)

    def make():
        letters = letter_table()
        known = []
        for name in names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            known.append((codes[order], order))

        def work(texts):
            langs, scores = [], []
            for t in texts:
                own = profile(grams(t, letters), size)
                if not len(own) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                far = [out_of_place(own, codes, ranks, size) for codes, ranks in known]
                best = min(range(len(far)), key=far.__getitem__)
                langs.append(names[best])
                scores.append(1.0 - far[best] / (len(own) * size))
            return [langs, scores]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, text, fields, make, keep)


def op2_language_id(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    profiles = learn(docs.filter(~F.col("held_out")))
    return predict(docs, profiles, keep=["doc_id", "held_out"])
