"""Graph operators on edge tables: PageRank, shortest paths, reachability, grids, assignment."""

from __future__ import annotations

import math
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslab.plans.buckets import Buckets
from corpuslab.plans.skew import hot_keys, join_small_or_salted
from corpuslab.plans.storage import written

# Damping and number of rounds of the page ranking.
RESET = 0.15
ROUNDS = 6


def edges_from_links(df: DataFrame, src: str, links: str) -> DataFrame:
    """(src, dst) once per pair; self-loops stay; a NULL link array gives no edge.

    Repeats can only occur inside one row, so they are removed in the row.
    """
    targets = F.array_distinct(F.transform(F.col(links), lambda a: a["id"]))
    return df.select(F.col(src).alias("src"), F.explode_outer(targets).alias("dst")).filter("dst IS NOT NULL")


def vertices(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id): all targets and all sources, also sources without links."""
    starts = edges.select(F.col("src").alias("id")) if sources is None else sources.select("id")
    return starts.union(edges.select(F.col("dst"))).distinct()


def _by_source(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges partitioned by source for repeated joins, and the salts of the hot_keys sources.

    A source with very many edges is spread over partitions by its out-degree. Returns
    (edges with salt and out-degree, (src, __salts) of the heavy sources, or None when
    there is no heavy source).
    """
    degree = written(edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    salted, heavy = _salted(edges, degree)
    # sorted once here, so that no round sorts the edges again
    spread = salted.repartition("src", "salt").sortWithinPartitions("src", "salt")
    placed = spread.join(_to_sources(degree, heavy), ["src", "salt"])
    return placed.persist(StorageLevel.MEMORY_AND_DISK), heavy


def _salted(edges: DataFrame, degree: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges with the salt of their source, and the salts of the heavy sources or None."""
    heavy = written(hot_keys(degree, ["src"], "degree"), "heavy-sources")
    if heavy.isEmpty():
        return edges.withColumn("salt", F.lit(0)), None
    salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("__salts")).cast("int"), F.lit(0))
    return edges.join(F.broadcast(heavy), "src", "left").withColumn("salt", salt).drop("__salts"), heavy


def _ways(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(src, ways) with the edges (dst, weight) of a source in one row, or (src, salt, ways) if any is heavy, and the salts as above.

    A round joins sources, of which there are far fewer than edges, and reads the edges of those that it takes.
    """
    salted, heavy = _salted(edges, edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
    # as many partitions as the joins of the rounds have, which shuffles the edges only here
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["src"] if heavy is None else ["src", "salt"]  # a salt that is always 0 would hide from joins how rows lie
    ways = salted.repartition(n, *by).sortWithinPartitions(*by).groupBy(*by).agg(F.collect_list(F.struct("dst", "weight")).alias("ways"))
    return ways.persist(StorageLevel.MEMORY_AND_DISK), heavy


def _to_sources(values: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Rows (src, ...) with salt 0, and once more per further salt of a heavy source."""
    first = values.withColumn("salt", F.lit(0))
    if heavy is None:
        return first
    # at most HOT_KEYS rows are broadcast; their copies are made after the join
    copies = values.join(F.broadcast(heavy), "src").withColumn("salt", F.explode(F.sequence(F.lit(1), F.col("__salts") - 1)))
    return first.unionByName(copies.drop("__salts"))


def pagerank(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    reset: float = RESET,
    max_iter: int = ROUNDS,
    rescale: bool = True,
    cut_every: int = 3,
) -> DataFrame:
    """(id, pagerank) after a fixed number of rounds.

    Ranks start at 1 and are not normalised in between; with ``rescale`` the
    result is scaled to sum to the number of vertices. Edges are shuffled once;
    a round moves only ranks and partial sums.
    """
    edges = written(edges.select("src", "dst"), "edges")
    nodes = written((vertices(edges) if nodes is None else nodes).select("id"), "vertices")
    placed, salts = _by_source(edges)
    zero = nodes.select("id", F.lit(0.0).alias("part"))
    ranks = nodes.select("id", F.lit(1.0).alias("pagerank"))
    for i in range(1, max_iter + 1):
        sources = _to_sources(ranks.select(F.col("id").alias("src"), "pagerank"), salts)
        sent = sources.join(placed, ["src", "salt"]).select(
            F.col("dst").alias("id"), (F.col("pagerank") / F.col("degree")).alias("part"))
        # vertices without incoming edges take part with a zero, which saves an outer join
        ranks = zero.unionByName(sent).groupBy("id").agg(
            (F.lit(reset) + F.lit(1 - reset) * F.sum("part")).alias("pagerank")
        )
        if i % cut_every == 0 or i == max_iter:
            ranks = written(ranks, "ranks")
    placed.unpersist()
    if not rescale:
        return ranks
    total, n = ranks.agg(F.sum("pagerank"), F.count(F.lit(1))).first()
    return ranks.select("id", (F.col("pagerank") * F.lit((n / total) if total else 1.0)).alias("pagerank"))


# Tables of single rounds that are read together before they are written as one.
COMPACT = 16


def _allow(rounds: int, most: int | None) -> None:
    if most is not None and rounds >= most:
        raise RuntimeError(f"not finished after {most} rounds")


def shortest_paths(
    edges: DataFrame, sources: DataFrame, max_iter: int | None = None, delta: float | None = None
) -> DataFrame:
    """(id, dist, pred) of every vertex that the sources reach over edges (src, dst, weight).

    Each round relaxes edges of vertices whose distance just changed and adds what it improved to
    the known distances, which stay dealt out by vertex: a round shuffles its own steps only. With
    ``delta``, a round takes only changed vertices whose distance falls into the nearest interval of that
    width, so that few are relaxed before their distance is final. The last round is the one after which no
    distance changed. ``pred`` is the smallest id among equally short predecessors and NULL for a
    source. Weights must be positive. More rounds than a given ``max_iter`` are an error, not a
    partial result.
    """
    placed, salts = _ways(written(edges.select("src", "dst", "weight"), "edges"))
    kind = edges.schema["src"].dataType
    pred = "bigint" if isinstance(kind, T.IntegralType) else kind
    start = sources.select("id", F.lit(0).cast(edges.schema["weight"].dataType).alias("dist"), F.lit(None).cast(pred).alias("pred")).distinct()
    known = Buckets(start, "id", "paths")
    waiting = written(start.select("id", "dist"), "waiting")
    best = F.min(F.struct("dist", "pred"))
    for turn in count(1):
        front, later = waiting, None
        if delta is not None:
            nearest = waiting.agg(F.min("dist")).first()[0]
            if nearest is None:
                break
            within = F.floor(F.col("dist") / F.lit(delta)) <= math.floor(nearest / delta)
            front, later = waiting.filter(within), waiting.filter(~within)
        begun = front.select(F.col("id").alias("src"), "dist")
        ways = begun.join(placed, "src") if salts is None else _to_sources(begun, salts).join(placed, ["src", "salt"])
        steps = ways.select("src", "dist", F.explode("ways").alias("way")).select(
            F.col("way.dst").alias("id"), (F.col("dist") + F.col("way.weight")).alias("dist"), F.col("src").cast(pred).alias("pred"))
        tried = steps.groupBy("id").agg(best.alias("new")).join(known.read().groupBy("id").agg(best.alias("old")), "id", "left")
        found = written(
            tried.filter("old IS NULL OR new.dist < old.dist OR new.dist = old.dist AND new.pred < old.pred")
            .select("id", "new.dist", "new.pred", F.expr("old IS NULL OR new.dist < old.dist").alias("nearer")), "paths")
        known.add(found.drop("nearer"))
        waiting = found.filter("nearer").select("id", "dist")
        if later is not None:
            # of a vertex that waits and was improved, the shorter distance
            waiting = written(later.unionByName(waiting).groupBy("id").agg(F.min("dist").alias("dist")), "waiting")
        if waiting.isEmpty():
            break
        _allow(turn, max_iter)
    placed.unpersist()
    return known.close().groupBy("id").agg(best.alias("b")).select("id", "b.dist", "b.pred")


def routes(paths: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(target, hop, id): the vertices of the path to each target, hop 0 = the target.

    Routes longer than a given ``max_hops`` are an error.
    """
    step = targets.select(F.col("id").alias("target"), F.lit(0).alias("hop"), "id")
    step = written(step.join(paths.select("id"), "id", "left_semi"), "route")
    found = step
    for hop in count(1):
        step = written(
            step.join(paths.select("id", "pred"), "id").filter("pred IS NOT NULL")
            .select("target", F.lit(hop).alias("hop"), F.col("pred").alias("id")), "route")
        if step.isEmpty():
            break
        _allow(hop, max_hops)
        found = found.unionByName(step)
        if hop % COMPACT == 0:
            found = written(found, "routes")
    return found


def bfs(edges: DataFrame, sources: DataFrame, max_iter: int | None = None) -> DataFrame:
    """(id, hops): vertices that the sources reach, with the least number of edges.

    Reached vertices stay dealt out by vertex, so that a hop shuffles only the targets of its
    edges. More hops than a given ``max_iter`` are an error.
    """
    placed, salts = _by_source(written(edges.select("src", "dst"), "edges"))
    front = written(sources.select("id", F.lit(0).alias("hops")).distinct(), "reached")
    seen = Buckets(front, "id", "reached")
    for hop in count(1):
        front = written(
            _to_sources(front.select(F.col("id").alias("src")), salts).join(placed, ["src", "salt"])
            .select(F.col("dst").alias("id")).distinct()
            .join(seen.read().select("id"), "id", "left_anti")
            .withColumn("hops", F.lit(hop)),
            "reached",
        )
        if front.isEmpty():
            break
        _allow(hop, max_iter)
        seen.add(front)
    placed.unpersist()
    return seen.close()


# The eight moves on a grid; the first four are not diagonal.
MOVES = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))


def grid_edges(cells: DataFrame, moves: int = 8) -> DataFrame:
    """(row, col, to_row, to_col) between walkable cells one move apart.

    ``cells`` lists walkable cells, so walls and cells outside the grid have no row.
    """
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in MOVES[:moves]])
    tried = cells.select("row", "col", F.explode(steps).alias("m")).select(
        "row", "col", (F.col("row") + F.col("m.r")).alias("to_row"), (F.col("col") + F.col("m.c")).alias("to_col")
    )
    there = cells.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    return tried.join(there, ["to_row", "to_col"]).select("row", "col", "to_row", "to_col")


def assign(
    requests: DataFrame, spots: DataFrame, distance_weight: float = 1.0, load_weight: float = 1.0,
    kind_weight: float = 1.0,
) -> DataFrame:
    """Best spot of its zone for each request: request_id, spot, score (least is best, ties by spot).

    score = distance_weight*distance + load_weight*load + kind_weight when the
    spot is not of the wanted kind. The score depends on a request only through
    (zone, kind). So the best spot per zone and kind is found first, then the best
    per kind of request, and requests join that small table; request-spot pairs
    are never formed. A spot without distance or load has no score and is not chosen.
    """
    base = F.col("distance") * F.lit(distance_weight) + F.col("load") * F.lit(load_weight)
    best = spots.filter(base.isNotNull()).groupBy("zone", F.col("kind").alias("spot_kind")).agg(
        F.min(F.struct(base.alias("base"), "spot")).alias("b")
    )
    wants = requests.select("zone", "kind").distinct()
    other = F.when(F.col("kind") == F.col("spot_kind"), F.lit(0.0)).otherwise(F.lit(kind_weight))
    choice = (
        wants.join(best, "zone")
        .groupBy("zone", "kind")
        .agg(F.min(F.struct((F.col("b.base") + other).alias("score"), F.col("b.spot").alias("spot"))).alias("c"))
        .select("zone", "kind", "c.spot", "c.score")
    )
    return join_small_or_salted(requests, choice, ["zone", "kind"], ["request_id"]).select(
        "request_id", "spot", "score"
    )
