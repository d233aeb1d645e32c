"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits: a bit is set when it is set in over half of the hashes of
the text's features. Fingerprints that differ in at most two bits agree in at least two
of four 16-bit blocks, so close pairs meet under one of six 32-bit keys and are verified
by Hamming distance. Keys shared by many fingerprints are not paired: there each
fingerprint is listed under all 65 values at distance one or less, and two fingerprints
are linked exactly when they share such a value, which takes linear work.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslab.llm import jaccard_join
from corpuslab.llm.common import map_text, quoted, row_keys, without
from corpuslab.llm.components import components
from corpuslab.llm.shingle_sets import SEED, hashes, shingle_set, shingles, words  # noqa: F401
from corpuslab.plans.storage import scratch, written

BLOCKS = 4
BLOCK_BITS = 16
DISTANCE = 2
# Keys with more fingerprints than this take the linear way.
PAIRED = 32
# A fingerprint is frequent when it holds at least 1/HOT of all rows.
HOT = 256


def over_half(hashed: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    bits = np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashed)
    return int.from_bytes(np.packbits(most).tobytes(), "big", signed=True)


def majority(features: list[bytes], seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number; zero without features."""
    return over_half(hashes(features, seed)) if features else 0


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``: the fingerprint of the ``size``-word shingles; null and empty texts get zero."""

    def make():
        return lambda texts: [[majority(shingles(words(t), size)) for t in texts]]

    return map_text(docs, text, [T.StructField("fp", T.LongType())], make, keep)


def distance(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def close_pairs(prints: DataFrame) -> DataFrame:
    """(tag, a, b): links between fingerprints of one tag at two or fewer differing bits.

    ``prints`` holds distinct (tag, fp). Every close pair is either listed itself or joined
    through one fingerprint that lies close to both, so no connection is lost.
    """
    masks = []
    for agree in combinations(range(BLOCKS), BLOCKS - DISTANCE):
        mask = sum(0xFFFF << (BLOCK_BITS * block) for block in agree)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = prints.select("tag", "fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)
    ])).alias("key"))
    # keys that collide only make more pairs to verify
    key = ["tag", "key"]
    shared = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(keys.join(shared, key), "blocks")
    few = met.filter(F.col("n") <= PAIRED)
    pairs = (
        few.select(*key, F.col("fp").alias("a")).join(few.select(*key, F.col("fp").alias("b")), key)
        .filter((F.col("a") < F.col("b")) & (distance("a", "b") <= DISTANCE)).select("tag", "a", "b")
    )
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    around = met.filter(F.col("n") > PAIRED).select("tag", "fp").distinct().select("tag", "fp", F.explode(flips).alias("value"))
    least = around.groupBy("tag", "value").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = (
        around.join(least, ["tag", "value"]).filter(F.col("a") < F.col("fp"))
        .select("tag", "a", F.col("fp").alias("b")).filter(distance("a", "b") <= DISTANCE)
    )
    return pairs.union(stars).distinct()


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 3) -> DataFrame:
    """One row per row of ``docs``: (id, fp, component_id).

    ``component_id`` is the smallest id in rows whose fingerprints are reachable; it is
    null only where all of those ids are null. Repeated rows come back repeated.
    """
    given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text"))
    rows = written(fingerprints(given, "text", size, ["id"]), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    links = close_pairs(prints.select(F.lit(0).alias("tag"), "fp")).select("a", "b")
    member = components(links).withColumnRenamed("node", "fp")
    member = member.join(prints, "fp")
    joined = member.join(member.groupBy("root").agg(F.min("least").alias("linked")), "root").select("fp", "linked")
    ids = written(prints.join(joined, "fp", "left").select("fp", "n", F.coalesce("linked", "least").alias("component_id")), "classes")
    # fingerprints with at least 1/HOT of the rows, at most HOT of them, are looked up where the rows are
    cut = rows.count() / HOT
    frequent = F.broadcast(ids.filter(F.col("n") >= cut).drop("n"))
    marked = rows.join(frequent.withColumn("frequent", F.lit(True)), "fp", "left")
    rest = marked.filter("frequent IS NULL").select("id", "fp").join(ids.filter(F.col("n") < cut), "fp")
    out = ["id", "fp", "component_id"]
    return marked.filter("frequent").select(*out).union(rest.select(*out))


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of near copies does.

    Near copies share at least 0.8 of their distinct five-word shingles; those are found by
    prefixes and signature trees, which keep the sets themselves out of all but one shuffle. Of a
    group, the smallest id stays (null ids last, equal ids by row). All null texts and texts without
    words are one group. An empty table gives no rows.
    """
    rows, row = row_keys(docs)
    with scratch(docs.sparkSession) as scope:
        found = jaccard_join.join(rows, text, id_col, row)
        # one row of all that have no words
        empty = found.filter("n_shingles = 0")
        least = empty.agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("least")).select(F.col("least.row").alias("row"))
        dropped = found.filter("n_shingles > 0 AND row <> first_row").select("row").unionByName(
            empty.select("row").join(F.broadcast(least), "row", "left_anti"))
        dropped = scope.result(dropped.withColumnRenamed("row", row), "dropped")
    return without(rows, dropped, row).drop(row)


def op6_simhash(spark, sf_dir):
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
