"""Multi-round clustering in three sets: discard (main clusters), compressed (side clusters) and retained points.

State between rounds: two small tables of sufficient statistics, the memberships so far, and the retained points.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import cluster as C
from quarry.session import cut

IN, MERGE = 4.0, 16.0


class State(NamedTuple):
    discard: DataFrame  # cluster, n, sum, sumsq
    compressed: DataFrame  # the same; names go on after the discard clusters
    members: DataFrame  # id, cluster
    retained: DataFrame  # id, vector


def kmeans(points: DataFrame, k: int) -> DataFrame:
    return C.lloyd(points.select("id", "vector"), C.farthest_first(points, k))


def added(stats: DataFrame, more: DataFrame) -> DataFrame:
    """Statistics are additive: sums by cluster and dimension."""
    both = stats.unionByName(more)
    long = both.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "z"))
    by_dim = long.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("z.sum").alias("s"), F.sum("z.sumsq").alias("q"))
    packed = by_dim.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s", "q"))).alias("_d"))
    return packed.select("cluster", "n", F.transform("_d", lambda d: d["s"]).alias("sum"), F.transform("_d", lambda d: d["q"]).alias("sumsq"))


def split_singles(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    sized = cut(assigned.join(sizes, "cluster"))
    return sized.where(F.col("_n") > 1).drop("_n"), sized.where(F.col("_n") == 1).drop("_n", "cluster")


def start(points: DataFrame, k: int) -> State:
    """First round: half of the points seed the discard clusters, the rest goes to the other two sets."""
    points = cut(points.select("id", "vector"))
    half = cut(points.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0))
    rough, _ = split_singles(kmeans(half, 2 * k))
    core = C.renumbered(kmeans(rough.select("id", "vector"), k))
    rest = points.join(core.select("id"), "id", "left_anti")
    side, single = split_singles(kmeans(rest, 2 * k))
    side = C.renumbered(side).withColumn("cluster", F.col("cluster") + 1_000_000)
    members = core.select("id", "cluster").unionByName(side.select("id", "cluster"))
    return State(cut(C.statistics(core)), cut(C.statistics(side)), cut(members), cut(single.select("id", "vector")))


def merged(stats: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Side clusters whose centres are near (squared Euclid under ``MERGE`` times the dimensions) become one: the nearest pair at a time."""
    while True:
        d = C.described(stats).select("cluster", "centre")
        pairs = d.alias("x").join(d.alias("y"), F.col("x.cluster") < F.col("y.cluster"))
        distance = V.squared_distance(F.col("x.centre"), F.col("y.centre"))
        pairs = pairs.select(F.col("x.cluster").alias("a"), F.col("y.cluster").alias("b"), distance.alias("d"), F.size("x.centre").alias("dims"))
        best = pairs.where(F.col("d") < MERGE * F.col("dims")).orderBy("d", "a", "b").limit(1).collect()
        if not best:
            return stats, members
        a, b = best[0]["a"], best[0]["b"]
        name = F.when(F.col("cluster") == b, F.lit(a)).otherwise(F.col("cluster")).alias("cluster")
        one = stats.select(name, "n", "sum", "sumsq")
        stats = cut(added(one, one.limit(0)))
        members = cut(members.select("id", name))


def advance(state: State, points: DataFrame, k: int) -> State:
    """One more round of points."""
    dis = C.described(state.discard).select("cluster", "centre", "variance")
    com = C.described(state.compressed).select("cluster", "centre", "variance")
    placed = cut(C.first_within(points.select("id", "vector"), dis, IN))
    inside, rest = placed.where("cluster IS NOT NULL"), placed.where("cluster IS NULL").drop("cluster")
    again = cut(C.first_within(rest, com, IN))
    beside, left = again.where("cluster IS NOT NULL"), again.where("cluster IS NULL").drop("cluster")
    discard = cut(added(state.discard, C.statistics(inside)))
    compressed = cut(added(state.compressed, C.statistics(beside)))
    members = state.members.unionByName(inside.select("id", "cluster")).unionByName(beside.select("id", "cluster"))
    retained = cut(state.retained.unionByName(left.select("id", "vector")))
    if retained.count() > 2 * k:
        side, single = split_singles(kmeans(retained, 2 * k))
        top = compressed.agg(F.coalesce(F.max("cluster"), F.lit(1_000_000))).first()[0]
        side = C.renumbered(side).withColumn("cluster", F.col("cluster") + top + 1)
        compressed = cut(compressed.unionByName(C.statistics(side)))
        members = members.unionByName(side.select("id", "cluster"))
        retained = cut(single.select("id", "vector"))
    compressed, members = merged(compressed, cut(members))
    return State(discard, compressed, members, retained)


def metrics(state: State, number: int) -> DataFrame:
    """One row: clusters and points of each set after a round."""
    d = state.discard.agg(F.count(F.lit(1)).alias("n_discard_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_discard_points"))
    c = state.compressed.agg(F.count(F.lit(1)).alias("n_compressed_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_compressed_points"))
    r = state.retained.agg(F.count(F.lit(1)).alias("n_retained_points"))
    return d.crossJoin(c).crossJoin(r).select(F.lit(number).alias("round"), "*")


def final(state: State) -> DataFrame:
    """``id, cluster``: side clusters near a main one (nearest, within the merging radius) join it; all else is -1."""
    dis = C.described(state.discard).select("cluster", "centre")
    side = C.described(state.compressed).select(F.col("cluster").alias("id"), F.col("centre").alias("vector"))
    near = C.nearest(side, dis)
    joined = near.where(F.col("distance") < MERGE * F.size("vector")).select(F.col("id").alias("_side"), F.col("cluster").alias("_main"))
    main = F.when(F.col("cluster") < 1_000_000, F.col("cluster")).otherwise(F.coalesce("_main", F.lit(-1)))
    placed = state.members.join(joined, F.col("cluster") == F.col("_side"), "left").select("id", main.cast("int").alias("cluster"))
    return placed.unionByName(state.retained.select("id", F.lit(-1).alias("cluster")))


def bfr(rounds: list[DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
    """Labels of all points, and metrics of each round."""
    state = start(rounds[0], k)
    rows = metrics(state, 1)
    for number, points in enumerate(rounds[1:], 2):
        state = advance(state, points, k)
        rows = rows.unionByName(metrics(state, number))
    return final(state), rows
