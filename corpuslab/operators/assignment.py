"""Assignment of requests to spots that hold one request each, by deferred acceptance.

A request wants the spot of its zone with the least score: weighted distance from its own target,
plus load, plus a penalty for another kind. A spot takes the request with the least score. Requests of one zone,
target and kind, a class, score all spots alike, so classes propose instead of requests: in a
round each class proposes to as many of its next best spots as it has requests without a spot, and each spot
keeps the best proposal. A class that loses a spot goes on down its list. When no class has both a request
and a spot left, the held spots go to the requests of the class in their order. No table of
requests by spots is formed: a class lists each spot of its zone once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslab.plans.ranking import group_places
from corpuslab.plans.skew import join_small_or_salted
from corpuslab.plans.storage import written

SCORE_DIGITS = 6


def class_lists(
    wants: DataFrame, spots: DataFrame, distances: DataFrame, distance_weight: float, load_weight: float, kind_weight: float
) -> DataFrame:
    """(zone, target, kind, spot, score, place): all spots of the zone of each class, best first.

    ``wants``: (zone, target, kind); ``spots``: (zone, spot, kind, load); ``distances``: (zone, target, spot,
    distance). A spot without distance from the target, or without load, is on no list of it.
    """
    offers = distances.join(spots.withColumnRenamed("kind", "spot_kind"), ["zone", "spot"])
    base = F.col("distance") * F.lit(distance_weight) + F.col("load") * F.lit(load_weight)
    rows = join_small_or_salted(offers.filter(base.isNotNull()), wants, ["zone", "target"], ["spot"])
    other = F.when(F.col("kind") == F.col("spot_kind"), F.lit(0.0)).otherwise(F.lit(kind_weight))
    rows = rows.select("zone", "target", "kind", "spot", F.round(base + other, SCORE_DIGITS).alias("score"))
    return group_places(rows, ["zone", "target", "kind"], [F.asc("score"), F.asc("spot")])


CLASS = ["zone", "target", "kind"]


def hold(lists: DataFrame, demand: DataFrame) -> DataFrame:
    """(zone, target, kind, spot, score): the spots that each class ends up with.

    ``lists`` comes from :func:`class_lists`, ``demand`` is (zone, target, kind, n). Every spot has at most one
    row. Of equal scores a spot prefers the smaller class, a class the smaller spot.
    """
    lists = written(lists, "lists")
    length = lists.groupBy(*CLASS).agg(F.max("place").alias("length"))
    # how far down its list each class has proposed, and how many requests wait
    state = written(demand.join(length, CLASS).select(*CLASS, "n", "length", F.lit(0).cast("long").alias("asked"), F.col("n").alias("waiting")), "classes")
    held = lists.limit(0).drop("place")
    best = F.min(F.struct("score", *CLASS)).alias("best")
    while True:
        asking = state.filter("waiting > 0 AND asked < length")
        if asking.isEmpty():
            return held
        turn = F.col("place").between(F.col("asked") + 1, F.col("asked") + F.col("waiting"))
        proposed = join_small_or_salted(lists, asking, CLASS, ["spot"]).filter(turn).select(*held.columns)
        held = written(held.unionByName(proposed).groupBy("zone", "spot").agg(best).select(
            *[F.col(f"best.{c}").alias(c) if c != "zone" else F.col("zone") for c in CLASS], "spot", "best.score"), "held")
        kept = held.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("kept"))
        asked = F.when(F.col("waiting") > 0, F.least(F.col("asked") + F.col("waiting"), F.col("length"))).otherwise(F.col("asked"))
        state = written(state.join(kept, CLASS, "left").select(
            *CLASS, "n", "length", asked.alias("asked"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("waiting")), "classes")


def assign_spots(
    requests: DataFrame, spots: DataFrame, distances: DataFrame, order: list[Column],
    distance_weight: float = 1.0, load_weight: float = 1.0, kind_weight: float = 1.0,
) -> DataFrame:
    """(request_id, spot, score) of every request; without a spot left on its list, spot and score are NULL.

    ``requests``: (request_id, zone, target, kind, ...) with ``order`` telling which of a class comes first.
    The result is stable: no request and spot would both rather have each other.
    """
    demand = written(requests.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n")), "demand")
    lists = class_lists(demand.select(*CLASS), spots, distances, distance_weight, load_weight, kind_weight)
    held = group_places(hold(lists, demand), CLASS, [F.asc("score"), F.asc("spot")])
    queue = group_places(requests, CLASS, [*order, F.asc("request_id")])
    # a (class, place) has one request and one spot at most
    return queue.join(held, [*CLASS, "place"], "left").select("request_id", "spot", "score")
