"""Clusters: sufficient statistics, assignment, farthest-first seeding, Lloyd's rounds, and multi-round summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.session import cut


def statistics(assigned: DataFrame) -> DataFrame:
    """``cluster, n, sum, sumsq`` of ``cluster, vector``: per dimension, by partial sums."""
    long = assigned.select("cluster", F.posexplode("vector").alias("dim", "x"))
    by_dim = long.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    packed = by_dim.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s", "q"))).alias("_d"))
    return packed.select("cluster", "n", F.transform("_d", lambda d: d["s"]).alias("sum"), F.transform("_d", lambda d: d["q"]).alias("sumsq"))


def described(stats: DataFrame) -> DataFrame:
    """Adds ``centre`` and ``variance`` (population, never below zero)."""
    centre = F.transform("sum", lambda s: s / F.col("n"))
    variance = F.zip_with("sum", "sumsq", lambda s, q: F.greatest(F.lit(0.0), q / F.col("n") - (s / F.col("n")) * (s / F.col("n"))))
    return stats.select("*", centre.alias("centre"), variance.alias("variance"))


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``id, vector, cluster, distance``: the nearest centre (squared Euclid), the smallest name among ties.

    ``centres`` (``cluster, centre``) are as many as clusters and go to every task as one array, so points are not multiplied.
    """
    packed = centres.agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("_c"))
    measured = F.transform("_c", lambda c: F.struct(V.squared_distance(F.col("vector"), c["centre"]).alias("distance"), c["cluster"].alias("cluster")))
    best = F.array_min(measured)
    out = points.crossJoin(F.broadcast(packed)).withColumn("_b", best)
    return out.select(*points.columns, F.col("_b.cluster").alias("cluster"), F.col("_b.distance").alias("distance"))


def first_within(points: DataFrame, clusters: DataFrame, factor: float = 4.0, closest: bool = False) -> DataFrame:
    """``cluster`` of the first (by name) or closest cluster with a squared Mahalanobis distance under ``factor`` times the dimensions; null if none.

    ``clusters``: ``cluster, centre, variance``.
    """
    packed = clusters.agg(F.sort_array(F.collect_list(F.struct("cluster", "centre", "variance"))).alias("_c"))
    measured = F.transform(
        "_c",
        lambda c: F.struct(
            V.squared_mahalanobis(F.col("vector"), c["centre"], c["variance"]).alias("distance"), c["cluster"].alias("cluster")
        ),
    )
    inside = F.filter(measured, lambda m: m["distance"] < factor * F.size("vector"))
    chosen = F.array_min(inside)["cluster"] if closest else F.array_min(F.transform(inside, lambda m: m["cluster"]))
    out = points.crossJoin(F.broadcast(packed)).withColumn("cluster", F.when(F.size("_c") > 0, chosen))
    return out.select(*[c for c in points.columns if c != "cluster"], "cluster")


def farthest_first(points: DataFrame, k: int) -> DataFrame:
    """``cluster, id, centre``: the point of smallest id, then each time the point farthest from all chosen; ties by id.

    Every point carries its distance to the nearest seed so far; a round is one scan that keeps a single row.
    """
    rows = cut(points.select("id", "vector"))
    seed = rows.orderBy("id").limit(1).collect()
    chosen = [(0, r["id"], r["vector"]) for r in seed]
    spread = rows.withColumn("least", F.lit(float("inf")))
    while chosen and len(chosen) < k:
        last = F.array(*[F.lit(float(x)) for x in chosen[-1][2]])
        spread = cut(spread.select("id", "vector", F.least("least", V.squared_distance(F.col("vector"), last)).alias("least")))
        top = spread.orderBy(F.desc("least"), "id").limit(1).collect()
        if not top or top[0]["least"] <= 0:
            break
        chosen.append((len(chosen), top[0]["id"], top[0]["vector"]))
    return points.sparkSession.createDataFrame(chosen, "cluster int, id long, centre array<double>")


def lloyd(points: DataFrame, seeds: DataFrame, rounds: int = 40, still: float = 4.0) -> DataFrame:
    """``id, vector, round, cluster`` after Lloyd's rounds, until centres move by no more than ``still`` (sum of squares); empty clusters vanish."""
    points = cut(points)
    centres = cut(seeds.select("cluster", "centre"))
    for _ in range(rounds):
        assigned = nearest(points, centres)
        moved = cut(described(statistics(assigned)).select("cluster", "centre"))
        change = moved.join(centres.withColumnRenamed("centre", "_was"), "cluster").agg(
            F.sum(V.squared_distance(F.col("centre"), F.col("_was")))
        )
        centres, shift = moved, change.first()[0]
        if shift is None or shift <= still:
            break
    return nearest(points, centres).drop("distance")


def lloyd_centres(points: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """``cluster, n, centre`` after exactly ``rounds`` rounds."""
    centres = seeds.select("cluster", "centre")
    for _ in range(rounds):
        found = cut(described(statistics(nearest(points, centres))))
        centres = found.select("cluster", "centre")
    return found.select("cluster", "n", "centre")


def renumbered(assigned: DataFrame) -> DataFrame:
    """Clusters numbered from 0 by their old numbers: the window is over clusters, not points."""
    names = assigned.select("cluster").distinct().withColumn("_new", F.row_number().over(Window.orderBy("cluster")) - 1)
    return assigned.join(F.broadcast(names), "cluster").drop("cluster").withColumnRenamed("_new", "cluster")
