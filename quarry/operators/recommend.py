"""Collaborative filtering: item neighbours, user neighbours, and a cascade of fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` most similar rows for each target; ties by the neighbour ``b``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "b")
    return candidates.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def item_predictions(test: DataFrame, rated: DataFrame, model: DataFrame, n: int = 3) -> DataFrame:
    """``user, item, prediction``: mean of the user's ratings of the ``n`` items most similar, weighted by similarity.

    ``model``: both directions, ``a, b, similarity``.
    """
    mine = rated.select("user", F.col("item").alias("b"), "rating")
    near = test.join(model, test["item"] == model["a"]).drop("a").join(mine, ["user", "b"])
    near = nearest(near, ["user", "item"], n)
    value = F.sum(F.col("similarity") * F.col("rating")) / F.sum("similarity")
    return near.groupBy("user", "item").agg(value.alias("prediction"))


def user_predictions(test: DataFrame, rated: DataFrame, model: DataFrame, n: int = 5) -> DataFrame:
    """``user, item, prediction``: the user's mean and the weighted mean of what near users' ratings lie above their own means."""
    means = rated.groupBy("user").agg(F.avg("rating").alias("mean"))
    theirs = rated.select(F.col("user").alias("b"), "item", "rating").join(
        means.select(F.col("user").alias("b"), F.col("mean").alias("mean_b")), "b"
    )
    near = test.join(model, test["user"] == model["a"]).drop("a").join(theirs, ["b", "item"])
    near = nearest(near, ["user", "item"], n)
    above = F.sum(F.col("similarity") * (F.col("rating") - F.col("mean_b"))) / F.sum("similarity")
    return near.groupBy("user", "item").agg(above.alias("above")).join(means, "user").select(
        "user", "item", (F.col("mean") + F.col("above")).alias("prediction")
    )


def with_fallbacks(test: DataFrame, rated: DataFrame, model: DataFrame | None, n: int = 20, default: float = 4.8, near: DataFrame | None = None) -> DataFrame:
    """``user, item, prediction, path`` of every asked pair.

    A known item takes near users' ratings (``n`` of them, around means), or else the item's mean; an unknown item takes the user's
    mean, or else ``default``. ``near``: predictions by near users, if there are such already; then ``model`` isn't needed.
    """
    items = rated.groupBy("item").agg(F.avg("rating").alias("item_mean"))
    users = rated.groupBy("user").agg(F.avg("rating").alias("user_mean"))
    near = near if near is not None else user_predictions(test.select("user", "item").distinct(), rated, model, n)
    near = near.withColumnRenamed("prediction", "near")
    joined = test.join(items, "item", "left").join(users, "user", "left").join(near, ["user", "item"], "left")
    known = F.col("item_mean").isNotNull()
    value = F.when(known, F.coalesce("near", "item_mean")).otherwise(F.coalesce("user_mean", F.lit(default)))
    path = (
        F.when(known & F.col("near").isNotNull(), "near")
        .when(known, "item")
        .when(F.col("user_mean").isNotNull(), "user")
        .otherwise("default")
    )
    return joined.select("event_id", "user", "item", value.alias("prediction"), path.alias("path"))


def neighbour_lists(model: DataFrame) -> DataFrame:
    """``a, neighbours``: structs of similarity and neighbour, most similar first."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("less"), F.col("b").alias("b"))))
    return model.groupBy("a").agg(pairs.alias("_x")).select("a", F.transform("_x", lambda x: F.struct((-x["less"]).alias("similarity"), x["b"].alias("b"))).alias("neighbours"))
