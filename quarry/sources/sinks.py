"""Sinks: documents, lines, tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_document(df: DataFrame) -> DataFrame:
    """One row ``value``: the single row of ``df`` as a JSON object."""
    return df.limit(1).select(F.to_json(F.struct(*df.columns)).alias("value"))


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def pair_model(df: DataFrame, path: str) -> None:
    """``a, b, similarity`` as JSON lines ``{"b1", "b2", "sim"}``."""
    json_lines(df.select(F.col("a").alias("b1"), F.col("b").alias("b2"), F.col("similarity").alias("sim")), path)


def model_document(parts: dict[str, DataFrame], path: str) -> None:
    """A model of several tables: a folder of JSON lines for each, named as the parts of the document, so that none is gathered."""
    for name, df in parts.items():
        json_lines(df, f"{path}/{name}")


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a folder of CSV files with headers: a report that grows by micro-batches."""
    df.write.mode("append").option("header", True).csv(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """``size, line``: the itemsets of each size on a line, like ``('a', 'b'),('a', 'c')``, in lexical order."""
    quoted = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
    named = itemsets.select(F.size("items").alias("size"), "items", quoted.alias("shown"))
    grouped = named.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("items", "shown"))).alias("all"))
    return grouped.select("size", F.array_join(F.transform("all", lambda x: x["shown"]), ",").alias("line")).orderBy("size")


def community_report(communities: DataFrame) -> DataFrame:
    """``line``: each community's members, smaller communities first."""
    grouped = communities.groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members"))
    return grouped.orderBy(F.size("members"), "members").select(F.array_join(F.transform("members", lambda m: m.cast("string")), ", ").alias("line"))


def betweenness_report(edges: DataFrame) -> DataFrame:
    """``line``: ``('a', 'b'), value`` of each edge (``src, dst, betweenness``), highest first, then by its ends."""
    shown = F.format_string("('%s', '%s'), %s", F.col("src").cast("string"), F.col("dst").cast("string"), F.round("betweenness", 5).cast("string"))
    return edges.orderBy(F.desc(F.round("betweenness", 5)), "src", "dst").select(shown.alias("line"))


def text(df: DataFrame, path: str) -> None:
    """The single text column of ``df``; of a sorted one the files, by their names, hold the lines in its order."""
    df.write.mode("overwrite").text(path)


def prediction_line(df: DataFrame, order: str, prediction: str) -> DataFrame:
    """``line``: predictions by ``order``, separated by spaces."""
    grouped = df.agg(F.sort_array(F.collect_list(F.struct(order, prediction))).alias("all"))
    return grouped.select(F.array_join(F.transform("all", lambda x: x[prediction].cast("string")), " ").alias("line"))
