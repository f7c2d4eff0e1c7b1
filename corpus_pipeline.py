"""The corpus pipeline: language ID, quality rules, line dedup, MinHash near-dedup, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; all but the last return the
columns of ``docs``. Null ids pass through the deduplicating stages; see each operator for odd input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session
from quarry.llm import langid, lines, minhash, packing, rules
from quarry.llm.queries import vocabulary

NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, texts without letters and open cases go."""
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language's references."""
    return rules.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component stays; ``n_chars`` follows, and documents of which no line stays go."""
    out = lines.dedup_lines(docs, drop_emptied=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    gone = minhash.near_duplicates(docs, NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, "id", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed in sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express compression, minhash or BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is checkpointed, as the next stage reads it more than once."""
    session.ship(spark)
    docs = session.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = session.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
