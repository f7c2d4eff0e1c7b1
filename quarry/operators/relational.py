"""Counts, distinct counts, top-k, averages of averages, filtered joins and partition profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(rows: DataFrame, user: str, in_year: Column) -> DataFrame:
    """One row: all rows, those of the year, distinct users; one scan."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(in_year).alias("n_year"),
        F.count_distinct(user).alias("n_users"),
    )


def top_counts(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """The ``n`` commonest keys; ties by key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key).limit(n)


def top_words(words: DataFrame, stop: DataFrame, n: int) -> DataFrame:
    """Commonest of ``word`` that aren't in ``stop`` (``word``)."""
    return top_counts(words.join(stop, "word", "left_anti"), "word", n, "n_words")


def category_average(scores: DataFrame, categories: DataFrame, n: int, digits: tuple[int, int] = (3, 1), merge: bool = False) -> DataFrame:
    """Average score of each item, then of each category over its items; the best ``n``.

    ``scores``: ``item, score``; ``categories``: ``item, categories array``. ``merge`` asks for a sort-merge join.
    """
    means = scores.groupBy("item").agg(F.round(F.avg("score"), digits[0]).alias("mean"))
    categories = categories.hint("merge") if merge else categories
    spread = means.join(categories, "item").select(F.explode("categories").alias("category"), "mean")
    out = spread.groupBy("category").agg(F.round(F.avg("mean"), digits[1]).alias("stars"))
    return out.orderBy(F.desc("stars"), "category").limit(n)


def popular(rows: DataFrame, key: str, more_than: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews")).where(F.col("n_reviews") > more_than)


def partition_profile(rows: DataFrame) -> DataFrame:
    """``partition, n_items`` of the physical partitions of ``rows``."""
    return rows.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_items"))


def repartition_profile(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """``partition, n_items`` of the partitions that hold rows, after each row was sent to the one that ``key`` modulo ``n`` names."""
    return partition_profile(rows.repartitionById(n, F.pmod(key, F.lit(n)).cast("int")))


def filtered_join(left: DataFrame, right: DataFrame, on: str, keep: Column) -> DataFrame:
    """Inner join with the rows of ``right`` that pass ``keep``; repeated rows stay."""
    return left.join(right.where(keep), on)
