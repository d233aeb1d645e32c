"""Divergence of sources within a language, from a frequent-pattern tree of term rows.

A kept term's row lists the sources that use it with their counts, smallest source first. Of
two sources, every term adds f(p, q) to their divergence, with p and q from their counts. With
o the p of count 0, a row needs no entry for sources that do not use the term:

    sum of f(p, q) = V f(o, o') + sum of f(p, o') - f(o, o') + sum of f(o, q) - f(o, o')
                     + sum over terms of both of f(p, q) - f(p, o') - f(o, q) + f(o, o')

The second and third sums go over the distinct counts of a source. The last one goes over a
tree into which all rows are inserted with multiplicities: rows with the same first entries
share nodes, and a node adds its multiplicity times the correction of its source with each
ancestor's, once for all its terms. Rows are inserted in the order of their paths, spread over
tasks by ranges of paths, so that a task holds one path of its tree at a time; a node cut by
the edge of a range counts its terms on each side.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuslab.llm.common import quoted, slices
from corpuslab.plans.ranking import top_k
from corpuslab.plans.skew import join_small_or_salted
from corpuslab.plans.storage import written

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
# A task hands on its counts when it holds so many terms, and its corrections when it holds so many pairs.
HELD = 600_000
# Ranges of paths are cut by so many first entries.
RANGE_ENTRIES = 3
# A-Z in lower case; whatever is neither a letter A-Z nor beyond ASCII parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; the term '' counts a group's documents."""
    given = docs.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(name)
                          for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(held):
        for (lang, source), (times, seen) in held.items():
            terms = list(seen)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()), pa.array([times.get(t, 0) for t in terms], pa.int64()),
                pa.array(list(seen.values()), pa.int64())], schema=schema)

    def run(batches):
        from collections import Counter

        held: dict = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    times, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    terms = text.encode().translate(LETTERS).split()
                    times.update(terms)
                    seen.update(set(terms))
                    seen[b""] += 1
                if sum(len(seen) for _, seen in held.values()) > HELD:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    found = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """p of a count: 1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(12, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({total} + 2 * {terms} as decimal(20, 0))")


def gap(p: str, q: str) -> str:
    """f as SQL: floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


@lru_cache(maxsize=4096)
def ends(n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ancestors and nodes of a path of ``n``, for the nodes at ``depth`` or deeper."""
    node, above = np.tril_indices(n, -1)
    use = node >= depth
    return above[use], node[use]


class Walk:
    """The tree of the rows of one language, walked in the order of their paths.

    Held are the nodes from the root to the last row inserted, by source, count, p and the p of
    count 0. A node whose last row has been inserted adds its corrections with all ancestors and
    is left.
    """

    def __init__(self) -> None:
        self.path = np.empty((4, 0), np.int64)
        self.times = np.empty(0, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def insert(self, path: np.ndarray, times: int) -> None:
        n = min(self.path.shape[1], path.shape[1])
        other = (self.path[:2, :n] != path[:2, :n]).any(axis=0)
        same = int(other.argmax()) if other.any() else n
        self.leave(same)
        self.path = path
        self.times = np.concatenate([self.times[:same], np.zeros(path.shape[1] - same, np.int64)]) + times

    def leave(self, depth: int) -> None:
        """Leave the nodes at ``depth`` or deeper."""
        n = self.path.shape[1]
        if n > max(depth, 1):
            above, node = ends(n, depth)
            source, _, p, o = self.path
            p_node, o_node, p_above, o_above = p[node], o[node], p[above], o[above]
            each = gaps(p_node, p_above) - gaps(p_node, o_above) - gaps(o_node, p_above) + gaps(o_node, o_above)
            a, b = source[above], source[node]
            self.found.append((np.minimum(a, b) << 32 | np.maximum(a, b), each * self.times[node]))
            self.size += len(node)
            if self.size > HELD:
                self.add_up()
        self.times = self.times[:depth]
        self.path = self.path[:, :depth]

    def add_up(self) -> int:
        """Add up what is known of each pair; the number of pairs."""
        keys = np.concatenate([k for k, _ in self.found])
        values = np.concatenate([v for _, v in self.found])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.found = [(keys[first], np.add.reduceat(values, first))]
        self.size = len(first)
        return self.size

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hand over the pairs so far: (smaller source, larger source, correction)."""
        if not self.found:
            return (np.empty(0, np.int64),) * 3
        self.add_up()
        keys, values = self.found[0]
        self.found, self.size = [], 0
        return keys >> 32, keys & 0xFFFFFFFF, values


def tree_corrections(paths: DataFrame) -> DataFrame:
    """(lang, a, b, value): corrections of pairs of sources from the tree of ``paths``, parts to be summed.

    ``paths``: (lang, path, times) with ``path`` an array of (total, source, n, p, o) in their order.
    """
    # ranges are cut by the first entries, of which a sample goes to the driver
    start = F.transform(F.slice("path", 1, RANGE_ENTRIES), lambda x: F.struct(x["total"], x["source"], x["n"]))
    ordered = paths.repartitionByRange("lang", start).sortWithinPartitions("lang", "path")

    def run(batches):
        ids: dict[str, int] = {}
        names: list[str] = []
        walk, at = Walk(), None

        def out():
            a, b, value = walk.pairs()
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([at] * len(a), pa.string()), "a": pa.array([names[i] for i in a], pa.string()),
                "b": pa.array([names[i] for i in b], pa.string()), "value": pa.array(value, pa.int64())})

        for batch in batches:
            lists = batch.column("path")
            flat = lists.flatten()
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sources = []
            for name in flat.field("source").to_pylist():
                if name not in ids:
                    ids[name] = len(names)
                    names.append(name)
                sources.append(ids[name])
            nodes = np.stack([np.array(sources, np.int64), *[flat.field(c).to_numpy(zero_copy_only=False) for c in ("n", "p", "o")]])
            for i, (lang, times) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist())):
                if lang != at:
                    walk.leave(0)
                    yield from out()
                    walk, at = Walk(), lang
                walk.insert(nodes[:, edge[i] : edge[i + 1]], times)
                if walk.size > HELD and walk.add_up() > HELD:
                    yield from out()
        walk.leave(0)
        yield from out()

    return ordered.select("lang", "path", "times").mapInArrow(run, "lang string, a string, b string, value long")


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) that occurs.

    Part ``pair``: every other source of the language with the divergence over all kept terms;
    part ``term``: the ``top`` terms that the group uses more than its language. Kept are the terms
    in at least ``min_docs`` rows of the language. Null text, lang and source are empty strings;
    repeated rows count each time; a group without terms has pairs and no terms; ties go by item in
    UTF-8 order. An empty table gives no rows.
    """
    counts = written(term_counts(docs, text, lang, source), "term_counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("items"))
    kept = written(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept_terms")
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
    used = kept.select("lang", "term", "all_n", F.inline("items"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = join_small_or_salted(groups, languages, ["lang"], ["source"], "left").fillna(0, ["total", "terms", "all_total"])
    groups = written(groups.withColumn("o", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "groups")
    # what each source makes of each term it uses
    each = join_small_or_salted(used, groups, ["lang", "source"], ["term"])
    each = written(each.select(
        "lang", "source", "term", "total", "n", "o", share("n", "total", "terms").alias("p"),
        share("all_n", "all_total", "terms").alias("q")), "used_terms")

    path = F.array_sort(F.collect_list(F.struct("total", "source", "n", "p", "o"))).alias("path")
    rows = each.groupBy("lang", "term").agg(path)
    paths = written(rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")), "paths")
    both = tree_corrections(paths)

    alone = each.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("times"))
    alone = alone.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("own"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("other"), F.col("o").alias("other_o"))).alias("others"))
    left = groups.select("lang", "source", "o", "terms").join(alone, ["lang", "source"], "left")
    pairs = join_small_or_salted(left, others, ["lang"], ["source"])
    pairs = pairs.select("lang", "source", "o", "terms", "own", F.inline("others")).filter("source <> other")
    single = F.expr(f"aggregate(coalesce(own, array()), 0L, (s, x) -> s + x.times * ({gap('x.p', 'other_o')} - {gap('o', 'other_o')}))")
    none = F.when(F.col("terms") > 0, F.col("terms") * F.expr(gap("o", "other_o"))).otherwise(F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", "other", F.coalesce(single, F.lit(0).cast("long")).alias("single"), none.alias("none"))
    signed = pairs.select("lang", "source", "other", F.explode(F.array(
        F.struct(F.col("source").alias("a"), F.col("other").alias("b"), (F.col("none") + F.col("single")).alias("value")),
        F.struct(F.col("other").alias("a"), F.col("source").alias("b"), F.col("single").alias("value")))).alias("x")).select("lang", "x.*")
    signed = signed.unionByName(both).unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    value = signed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    placed = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    out = ["lang", "source", "part", "item", "value", "rank"]
    far = value.withColumn("rank", F.row_number().over(placed)).select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", "rank")
    more = each.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    # first within parts of a group, so that no task gets ten terms of every other
    cut = F.pmod(F.xxhash64("item"), F.lit(64))
    most = top_k(more.withColumn("cut", cut), ["lang", "source", "cut"], [F.desc("value"), F.col("item")], top).drop("rank", "cut")
    most = top_k(most, ["lang", "source"], [F.desc("value"), F.col("item")], top)
    return far.select(*out).unionByName(most.select(*out))


def op12_source_divergence(spark, sf_dir):
    """Divergence of the sources of all ``documents`` by language; see :func:`divergence` for odd rows."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(all_n) AS HUGEINT) AS all_total FROM t GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, t.term, coalesce(n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (coalesce(total, 0) + 2 * v) AS p,
             1 + 1000000000::HUGEINT * (all_n + 2) // (all_total + 2 * v) AS q
      FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
