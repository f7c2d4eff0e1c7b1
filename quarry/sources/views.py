"""Logical views on the test tables, and readers of the formats that jobs take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as X
from quarry.session import table

REVIEW = "user_id string, business_id string, stars double, text string, date string"
BUSINESS = "business_id string, categories string, state string, city string"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def tolerant_field(line: Column, name: str) -> Column:
    """One field of a JSON line as text; what can't be parsed or lacks the field is ''."""
    return F.coalesce(F.get_json_object(line, f"$.{name}"), F.lit(""))


def csv_with_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def csv_plain(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """``id, vector`` of comma lines: an index, then coordinates."""
    parts = F.transform(F.split("value", ","), lambda v: v.cast("double"))
    return spark.read.text(path).select(parts[0].cast("long").alias("id"), F.slice(parts, 2, F.size(parts) - 1).alias("vector"))


def rounds(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder in the order of their names: one for each round."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.isFile() and not f.getPath().getName().startswith(("_", ".")))


def pair_model(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, similarity`` of JSON lines ``{"b1", "b2", "sim"}``; lines that can't be parsed or lack an end are left out."""
    found = json_lines(spark, path, "b1 string, b2 string, sim double").where(F.col("b1").isNotNull() & F.col("b2").isNotNull())
    return found.select(F.col("b1").alias("a"), F.col("b2").alias("b"), F.col("sim").alias("similarity"))


def model_part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of one part of a model that ``sinks.model_document`` wrote."""
    return json_lines(spark, f"{path}/{name}", schema)


def words_of_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("word"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """``events`` replayed as a stream, with an event time that watermarks accept."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if len(spark.read.parquet(source).inputFiles()) == 1:  # a single file: streams read folders
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(source)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user, item, stars`` from events; repeated ratings stay."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("long").alias("item"),
        (1 + F.floor("value") % 5).cast("long").alias("stars"),
    )


def mean_ratings(rated: DataFrame) -> DataFrame:
    return rated.groupBy("user", "item").agg(F.avg("stars").alias("rating"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``basket, item``: brands of an order."""
    return basket_lines(spark, sf_dir).distinct()


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``basket, item`` of every line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item"))


def tokens(spark: SparkSession, sf_dir: str, by_doc: bool = False) -> DataFrame:
    """``doc, source, word``, one row for each word. ``by_doc``: texts, not words, are shuffled, so that a document's words are in one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.repartition("doc_id") if by_doc else docs
    return docs.select(F.col("doc_id").alias("doc"), "source", F.explode(X.tokens(F.col("text"))).alias("word"))


def points(spark: SparkSession, sf_dir: str, scale: float = 8.0) -> DataFrame:
    """``id, vector, round`` from embeddings, scaled to about unit variance."""
    rows = table(spark, sf_dir, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double") * scale)
    return rows.select(F.col("vec_id").alias("id"), vector.alias("vector"), (F.col("vec_id") % 5).alias("round"))
