"""N-gram Jaccard join: documents that share 0.8 of their distinct five-word shingles.

1. Candidates. In any one order of all shingles, two such sets of n and m have a shingle in
   common among the first n // 5 + 1 and m // 5 + 1. The order puts the shingles of a Misra-Gries
   list last and goes by hash otherwise. A shingle listed is shared by very many: the texts
   with it in their prefix are one cluster. Those with another one are a group, groups with rows in
   common are one up to ``BLOCK`` rows; a signature tree of each group is walked against itself, and pairs that its
   bounds leave are one cluster.
   Long texts share single shingles by chance, the more of them the more texts there are. Where few of a
   long text's shingles are listed, the others are dealt by hash to parts, of which two such sets
   differ in (n + m) / 9 at most, and its keys are its fullest parts, some two to four shingles each.
2. Links. Each text of a cluster of several goes to the cluster's task once, where its set is made anew.
   Signature trees are walked again and the sets of pairs left are compared, unless what is linked
   already connects them. Clusters above ``BLOCK`` texts are cut into blocks: first each block by
   itself, then each with the first one, then, where a cluster is still in several parts, all
   pairs of blocks that are not one part.

Equal sets are one node throughout, so that copies cost one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslab.llm import signature_tree
from corpuslab.llm.common import give_back, map_text, quoted, slices
from corpuslab.llm.components import components
from corpuslab.llm.shingle_sets import mixed, shingle_set
from corpuslab.plans.skew import fits_broadcast, hot_keys, salted_join
from corpuslab.plans.storage import scratch, written

# The share of distinct shingles, as a fraction.
SHARE = 4, 5
# Counters of a task for frequent shingles, and the length of the list.
COUNTERS = 1 << 18
# Shingles that a task has seen less often are not sent by it.
LEAST = 4
# Sets of so many shingles have parts for keys, and those of fewer than 5 / 4 of it a prefix.
LONG = 64
# Parts of a set of ``LONG`` shingles; they double when the shingles do.
PARTS = 48
# Sets that a task compares with each other.
BLOCK = 2048
# Rows and bytes of whole groups handled at once.
HELD_ROWS = 8192
HELD_BYTES = 4 << 20


# ---- frequent shingles


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def frequent_shingles(docs: DataFrame, text: str, counters: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with the most occurrences, at most ``counters`` of them, and their order.

    Misra-Gries summaries, one per task. A task leaves out what has at most 1 / ``counters`` of
    its occurrences or fewer than ``LEAST``, so that little is sent. Whatever has at least
    3 / ``counters`` of all occurrences and ``LEAST`` a task is listed. The list decides the order of
    shingles only, not which links are found.
    """

    def run(batches):
        keys, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in batches:
            for part in slices(batch, text):
                found = np.concatenate([shingle_set(t) for t in part.column(text).to_pylist()])
                total += len(found)
                new, times = np.unique(found, return_counts=True)
                keys, counts = added(np.concatenate([keys, new]), np.concatenate([counts, times]))
                if len(keys) > counters:
                    counts = counts - np.partition(counts, -counters - 1)[-counters - 1]
                    keys, counts = keys[counts > 0], counts[counts > 0]
        keep = (counts * counters > total) & (counts >= LEAST)
        yield pa.RecordBatch.from_pydict({
            "shingle": pa.array([None, *keys[keep].view(np.int64).tolist()], pa.int64()),
            "n": pa.array([total, *counts[keep].tolist()], pa.int64())})
        give_back()

    sums = docs.select(text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    sums = written(sums, "frequent_shingles")
    total = sums.filter("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    found = sums.filter(F.col("shingle").isNotNull() & (F.col("n") * counters >= total)).toArrow()
    keys = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.lexsort((keys, found.column("n").to_numpy()))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    by_key = np.argsort(keys)
    return keys[by_key], place[by_key]


def are_listed(found: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each shingle is listed, and where in the list."""
    if not len(frequent):
        return np.zeros(len(found), bool), np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    return frequent[at] == found, at


def prefix(found: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set that can be without a partner in a linked set, and one more: other, frequent."""
    over, under = SHARE
    n = len(found) * (under - over) // under + 1
    known, at = are_listed(found, frequent)
    other = found[~known][:n]
    if len(other) == n:
        return other, found[:0]
    last = found[known]
    return other, last[np.argsort(place[at[known]])][: n - len(other)]


def fullest_parts(other: np.ndarray, family: int, n: int) -> np.ndarray:
    """Keys of the ``n`` parts with the most shingles of ``other``, which is sorted, of the parts of ``family``.

    A key stands for the part and all that ``other`` has in it. Keys are ordered by themselves, those of fuller
    parts first, so that two sets order the parts that are equal in both alike. Linked sets differ in fewer than
    ``n`` parts; of the rest, the last one in this order is among the first ``n`` of each.
    """
    parts = PARTS << family
    part = ((other >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(part, minlength=parts)
    full = np.flatnonzero(count)
    content = np.zeros(parts, np.uint64)
    if len(full):
        content[full] = np.add.reduceat(mixed(other, 0), np.cumsum(count[full]) - count[full])
    key = mixed(content + mixed(np.arange(parts, dtype=np.uint64), family), 0)
    key = (key >> np.uint64(8)) | ((255 - np.minimum(count, 255)).astype(np.uint64) << np.uint64(56))
    return np.partition(key, n - 1)[:n]


def keys_of(found: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, of which linked sets have one in common: other, frequent.

    Linked sets X and Y of n <= m shingles have m <= 5 n / 4 and differ in (n + m) / 9 shingles at most, that is n / 4 and
    2 m / 9. Sets have parts if they have ``LONG`` shingles and at most 2 / 5 of them are listed, and a
    prefix if they have fewer than 5 / 4 ``LONG`` or more than a quarter is listed. So if one of the two has no parts, both
    have a prefix: if over 2 n / 5 of X are listed and X lacks b shingles of Y, which lacks a of X, then
    a <= n / 5 - 4 b / 5, and of Y over 2 n / 5 - a are listed, which is at least (n - a + b) / 4 = m / 4; likewise with X and Y exchanged.
    The parts of a family are those of sets from ``LONG << family`` to twice that and of up to 5 / 4 as many, their larger partners.
    """
    n = len(found)
    known, _ = are_listed(found, frequent)
    listed = int(np.count_nonzero(known))
    keys, last = [], found[:0]
    if 4 * n < 5 * LONG or 4 * listed > n:
        first, last = prefix(found, frequent, place)
        keys.append(first)
    if n >= LONG and 5 * listed <= 2 * n:
        other = found[~known]
        family = (n // LONG).bit_length() - 1
        keys.append(fullest_parts(other, family, n // 4 + 1))
        if family and 4 * n < 5 * (LONG << family):
            keys.append(fullest_parts(other, family - 1, 2 * n // 9 + 1))
    return np.concatenate(keys), last


# ---- groups


def whole_groups(batches, key: str, size: str | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in the order of ``key``, several groups at a time."""
    held: list[pa.RecordBatch] = []
    rows = large = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        large += batch.nbytes if size is None else int(np.sum(batch.column(size).to_numpy()))
        if rows < HELD_ROWS and large < HELD_BYTES:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        end = int(np.flatnonzero(keys == keys[-1])[0])
        if end:
            yield table.slice(0, end)
            held = table.slice(end).combine_chunks().to_batches()
            rows, large = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if rows:
        yield pa.Table.from_batches(held)


def shared_keys(prefixes: DataFrame) -> DataFrame:
    """(group, row, first) of the rows of ``prefixes`` (key, row) with a key of several.

    Keys with the same rows give the same group and its rows again, with the ``first`` of them. A key of more than
    ``BLOCK`` rows has no group; its rows come with their ``first`` too.
    """
    ordered = prefixes.repartition("key").sortWithinPartitions("key", "row")

    def batch_of(group, row, first):
        return pa.RecordBatch.from_arrays([group, pa.array(row, pa.int64()), first], names=["group", "row", "first"])

    def groups(keys, rows):
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(start, len(keys)))
        name = mixed(np.add.reduceat(mixed(rows.view(np.uint64), 0), start) + n.astype(np.uint64), 1).view(np.int64)
        several = np.repeat(n > 1, n)
        yield batch_of(*(pa.array(x[several], pa.int64()) for x in (np.repeat(name, n), rows, np.repeat(rows[start], n))))

    def run(batches):
        keys = rows = np.empty(0, np.int64)
        long = None  # the key of more than BLOCK rows at hand and its first row
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            rows = np.concatenate([rows, batch.column("row").to_numpy()])
            if long is not None:
                same = int(np.searchsorted(keys != long[0], True)) if (keys != long[0]).any() else len(keys)
                yield batch_of(pa.nulls(same, pa.int64()), rows[:same], pa.array([long[1]] * same, pa.int64()))
                keys, rows = keys[same:], rows[same:]
                if not len(keys):
                    continue
                long = None
            last = int(np.flatnonzero(keys == keys[-1])[0])
            done, done_rows = keys[:last], rows[:last]
            if last:
                # a key of many that begins and ends before the last one
                start = np.flatnonzero(np.concatenate([[True], done[1:] != done[:-1]]))
                n = np.diff(np.append(start, last))
                many = np.repeat(n > BLOCK, n)
                if many.any():
                    first = np.repeat(done_rows[start], n)[many]
                    yield batch_of(pa.nulls(len(first), pa.int64()), done_rows[many], pa.array(first, pa.int64()))
                    done, done_rows = done[~many], done_rows[~many]
                if len(done):
                    yield from groups(done, done_rows)
            keys, rows = keys[last:], rows[last:]
            if len(keys) > BLOCK:
                long = keys[0], rows[0]
                yield batch_of(pa.nulls(len(rows), pa.int64()), rows, pa.array([long[1]] * len(rows), pa.int64()))
                keys = rows = np.empty(0, np.int64)
        if len(keys):
            yield from groups(keys, rows)

    return ordered.mapInArrow(run, "group long, row long, first long")


def whole_parts(met: DataFrame) -> DataFrame:
    """(group, row): the groups of ``met`` (group, row, first), where all that are linked by common rows are one.

    Near copies share most keys, and each key brings those of them that have it; so a row goes to one group
    instead of one for each key. Groups that come to more than ``BLOCK`` rows stay as they are.
    """
    given = met.filter("group IS NOT NULL")
    parts = written(components(given.select(F.col("first").alias("a"), F.col("row").alias("b"))), "parts")
    large = written(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("root"), "large_parts")
    several = not large.isEmpty()
    large = F.broadcast(large) if fits_broadcast(large) else large
    whole = parts.join(large, "root", "left_anti").select(F.col("root").alias("group"), F.col("node").alias("row"))
    if not several:
        return whole
    inside = parts.join(large, "root", "left_semi").select(F.col("node").alias("row"))
    return whole.union(given.select("group", "row").distinct().join(inside, "row", "left_semi").select("group", "row"))


def tree_candidates(grouped: DataFrame) -> DataFrame:
    """(a, b): of each group of ``grouped`` (group, row, size, low, bits), pairs left by its trees, as few as connect them."""
    over, under = SHARE
    ordered = grouped.repartition("group").sortWithinPartitions("group")

    def run(batches):
        for table in whole_groups(batches, "group"):
            group, row, size, low = (table.column(c).to_numpy() for c in ("group", "row", "size", "low"))
            labels = signature_tree.Labels(len(row))
            a, b = [], []
            for i, j in signature_tree.candidate_pairs(group, size.astype(np.int64), low, table.column("bits").to_pylist(), over, under):
                apart = labels.label[i] != labels.label[j]
                for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                    if labels.join(x, y):
                        a.append(x)
                        b.append(y)
                labels.settle()
            yield pa.RecordBatch.from_arrays([pa.array(row[a], pa.int64()), pa.array(row[b], pa.int64())], names=["a", "b"])
        give_back()

    return ordered.mapInArrow(run, "a long, b long")


# ---- links


def tree_links(tasks: DataFrame) -> DataFrame:
    """(a, b): rows of ``tasks`` (task, row, side, part, text) that are linked, as few as connect them.

    Rows of a task that have the same ``part`` are connected already, and those of the same
    ``side`` are not compared, unless it is -1.
    """
    over, under = SHARE
    ordered = tasks.withColumn("size", F.octet_length("text")).repartition("task").sortWithinPartitions("task", "row")

    def run(batches):
        for table in whole_groups(batches, "task", "size"):
            task, row, side, part = (table.column(c).to_numpy() for c in ("task", "row", "side", "part"))
            sets = [shingle_set(t) for t in table.column("text").to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            low = np.fromiter((s[0] if len(s) else 0 for s in sets), np.uint64, len(sets))
            labels = signature_tree.Labels(len(row))
            first: dict = {}
            for i, key in enumerate(zip(task.tolist(), part.tolist())):
                labels.join(first.setdefault(key, i), i)
            labels.settle()
            a, b = [], []
            for i, j in signature_tree.candidate_pairs(task, size, low, [signature_tree.bitmap(s) for s in sets], over, under):
                use = (labels.label[i] != labels.label[j]) & ((side[i] != side[j]) | (side[i] < 0))
                for x, y in zip(i[use].tolist(), j[use].tolist()):
                    if labels.root(x) == labels.root(y):
                        continue
                    same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if same * (over + under) >= (size[x] + size[y]) * over:
                        labels.join(x, y)
                        a.append(x)
                        b.append(y)
                labels.settle()
            yield pa.RecordBatch.from_arrays([pa.array(row[a], pa.int64()), pa.array(row[b], pa.int64())], names=["a", "b"])
        give_back()

    return ordered.select("task", "row", "side", "part", "text", "size").mapInArrow(run, "a long, b long")


def parted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``part``: the smallest row that ``edges`` connect to each."""
    roots = components(edges).select(F.col("node").alias("row"), "root").distinct()
    return rows.join(roots, "row", "left").withColumn("part", F.coalesce("root", "row")).drop("root")


def blocked(cluster: str | list[str], n: str):
    """A block of the rows of a cluster, about half of ``BLOCK`` of them."""
    names = [cluster] if isinstance(cluster, str) else cluster
    return F.pmod(F.xxhash64(F.col("row"), F.lit("block"), *names), F.ceil(F.col(n) * 2 / BLOCK)).cast("int")


def pair_tasks(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows for :func:`tree_links`: those of both blocks of each of ``pairs`` (cluster, i, j), or of one if they are the same."""
    ends = pairs.withColumn("task", F.xxhash64("cluster", "i", "j"))
    ends = ends.select("cluster", "task", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(-1).alias("side"))))
                       .otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")),
                                          F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))).alias("x")).select("cluster", "task", "x.*")
    counts = rows.groupBy("cluster", "block").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(rows, ends, ["cluster", "block"], hot_keys(counts, ["cluster", "block"], "n", BLOCK), ["row"]).select(
        "task", "row", "side", "part", "text")


def large_links(texts: DataFrame) -> DataFrame:
    """(a, b): links that connect the rows of clusters above ``BLOCK`` rows; ``texts``: (cluster, n, row, text)."""
    rows = written(texts.withColumn("block", blocked("cluster", "n")), "blocks")
    edges = written(tree_links(rows.select(F.xxhash64("cluster", "block").alias("task"), "row", F.lit(-1).alias("side"), F.col("row").alias("part"), "text")), "links")
    # every block with the first one
    placed = written(parted(rows, edges), "parted")
    blocks = placed.select("cluster", F.col("block").alias("j")).distinct().filter("j > 0")
    stars = blocks.select("cluster", F.lit(0).alias("i"), "j")
    edges = written(edges.union(tree_links(pair_tasks(placed, stars))), "links")
    # parts of clusters that are still in several: large ones have blocks of their own, small ones share some
    placed = written(parted(rows.select("cluster", "row", "text"), edges), "parted")
    parts = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("in_part"))
    open_ = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("in_part") * 2 < BLOCK, F.col("in_part"))).alias("in_small"))
    open_ = written(open_.filter("parts > 1"), "open_clusters")
    if open_.isEmpty():
        return edges
    parts = parts.join(open_, "cluster")
    own = F.col("in_part") * 2 >= BLOCK
    parts = parts.select("cluster", "part", F.when(own, F.col("part")).alias("own"), F.when(own, F.col("in_part")).otherwise(F.col("in_small")).alias("n"))
    counts = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    rest = salted_join(placed, parts, ["cluster", "part"], hot_keys(counts, ["cluster", "part"], "n", BLOCK), ["row"])
    # blocks of one part have its number as name, shared ones none
    rest = rest.withColumn("block", F.xxhash64("own", blocked(["cluster", "own"], "n")))
    rest = written(rest.select("cluster", "block", "own", "part", "row", "text"), "parted")
    names = rest.select("cluster", "block", "own").distinct()
    a, b = (names.select("cluster", F.col("block").alias(x), F.col("own").alias(f"own_{x}")) for x in "ij")
    pairs = a.join(b, "cluster").filter("i < j AND NOT (own_i <=> own_j AND own_i IS NOT NULL) OR i = j AND own_i IS NULL")
    return edges.union(tree_links(pair_tasks(rest, written(pairs.select("cluster", "i", "j"), "block_pairs"))))


def links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b): links between ``nodes`` (row, id, text_key) that connect all linked ones.

    Linked nodes are in one cluster of ``candidates`` (a, b). ``docs`` holds (id, text).
    """
    clusters = components(candidates).select(F.col("node").alias("row"), F.col("root").alias("cluster")).distinct()
    clusters = written(clusters.join(nodes.select("row", "id", "text_key"), "row"), "clusters")
    wanted = clusters.select("row", "cluster", F.col("id").alias("node_id"), "text_key")
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    met = docs.withColumn("text_key", F.xxhash64("text")).join(wanted, "text_key").filter("id <=> node_id")
    # an id may have the same text in several rows
    texts = met.groupBy("row").agg(F.first("cluster").alias("cluster"), F.first("text").alias("text"))
    texts = written(texts, "cluster_texts")
    sizes = written(texts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "large_clusters")
    # at most rows / BLOCK clusters, so that their rows are told apart without a shuffle where they are few
    marked = texts.join(F.broadcast(sizes) if fits_broadcast(sizes) else sizes, "cluster", "left")
    small = marked.filter("n IS NULL").select(F.col("cluster").alias("task"), "row", F.lit(-1).alias("side"), F.col("row").alias("part"), "text")
    found = tree_links(small)
    if not sizes.isEmpty():
        found = found.union(large_links(marked.filter("n IS NOT NULL").select("cluster", "n", "row", "text")))
    return written(found, "links")


# ---- the join


def join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: (row, id, n_shingles, component_id, first_row).

    ``component_id`` is the smallest id that links reach, the row's own included; it is null only
    where all of those ids are null. ``first_row`` is the row with that id, the first of equal ones; ``row`` is
    a number that is different in each row, the one in the column ``row`` if that is given. A null text or one without words has no shingles and is
    linked with nothing. Repeated rows come back repeated; an empty table gives no rows.
    """
    given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    spark = docs.sparkSession
    listed = spark.sparkContext.broadcast(frequent_shingles(given, "text"))
    fields = [T.StructField("same", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("low", T.LongType()),
              T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("frequent", T.ArrayType(T.LongType())),
              T.StructField("bits", T.BinaryType())]

    def make():
        frequent, place = listed.value

        def work(texts):
            out = [[] for _ in fields]
            for t in texts:
                found = shingle_set(t)
                keys, last = keys_of(found, frequent, place)
                made = (blake2b(found.astype("<u8").tobytes(), digest_size=16).digest(), len(found),
                        int(found[:1].view(np.int64)[0]) if len(found) else None, keys.view(np.int64), last.view(np.int64),
                        signature_tree.bitmap(found))
                for column, value in zip(out, made):
                    column.append(value)
            return out
        return work

    number = F.monotonically_increasing_id() if row is None else F.col(quoted(row))
    numbered = docs.select(number.alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    rows = written(map_text(numbered.withColumn("text_key", F.xxhash64("text")), "text", fields, make, ["row", "id", "text_key"], tidy=True), "sets")
    # equal sets are one node, the row with the smallest id
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    sames = written(rows.filter("size > 0").groupBy("same").agg(first, F.count(F.lit(1)).alias("n")).select(
        "same", F.col("first.row").alias("node"), F.col("first.no_id").alias("no_id"), F.col("first.id").alias("id"), "n"), "nodes")
    hot = hot_keys(sames, ["same"], "n", max(2, rows.count() // 256))
    placed = salted_join(rows.select("row", "id", "size", "same"), sames.select("same", "node"), ["same"], hot, ["row"])
    repeats = placed.filter("row <> node").select("row")
    nodes = rows.filter("size > 0").join(F.broadcast(repeats) if fits_broadcast(repeats) else repeats, "row", "left_anti")

    with scratch(spark) as scope:
        with scratch(spark) as keyed:  # the keys are the largest shuffle and are not needed any more
            met = keyed.result(shared_keys(nodes.select(F.explode("keys").alias("key"), "row")), "shared_keys")
        pairs = tree_candidates(whole_parts(met).join(nodes.select("row", "size", "low", "bits"), "row"))
        stars = met.filter("group IS NULL AND row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
        # at most COUNTERS keys
        last = nodes.select(F.explode("frequent").alias("key"), "row")
        least = F.broadcast(last.groupBy("key").agg(F.min("row").alias("a")))
        stars = stars.union(last.join(least, "key").filter("row <> a").select("a", F.col("row").alias("b")))
        candidates = written(pairs.union(stars).distinct(), "candidates")
        edges = links(given, nodes, candidates)

        member = components(edges).select(F.col("node").alias("node"), "root").distinct()
        known = sames.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = known.groupBy("root").agg(F.min(F.struct("no_id", "id", "node")).alias("least"))
        known = known.join(least, "root").select("same", F.col("least.id").alias("component_id"), F.col("least.node").alias("first_row"))
        known = scope.result(known, "members")
    joined = salted_join(rows.filter("size > 0").select("row", "id", "size", "same"), known, ["same"], hot, ["row"])
    alone = rows.filter("size = 0").select("row", "id", "size", F.col("id").alias("component_id"), F.col("row").alias("first_row"))
    out = ["row", "id", F.col("size").cast("long").alias("n_shingles"), "component_id", "first_row"]
    return joined.select(*out).union(alone.select(*out))


def op13_jaccard_join(spark, sf_dir):
    """Links of all ``documents`` by five-word shingles; see :func:`join` for odd rows."""
    found = join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
