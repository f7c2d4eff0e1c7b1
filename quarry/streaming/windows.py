"""Streaming forms: windowed distinct counts, reservoir sampling, and runners for micro-batches."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators import sketch
from quarry.sources import sinks

TIME = "yyyy-MM-dd HH:mm:ss"


def windowed(rows: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``start, end, user_id`` once for each window of the event time; late rows are taken for ``late``."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.withWatermark("ts", late).groupBy(span.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n"
    )


def distinct_per_window(rows: DataFrame, length: str, slide: str) -> DataFrame:
    """Batch truth: ``start, n_users`` of every window."""
    spans = rows.select(F.window(F.col("ts").cast("timestamp"), length, slide).alias("w"), "user_id")
    return spans.groupBy("w").agg(F.count_distinct("user_id").alias("n_users")).select(F.col("w.start").alias("start"), "n_users")


def approximate_per_window(rows: DataFrame, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Streaming estimate: ``start, n_users``."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w")).agg(
        F.approx_count_distinct("user_id").alias("n_users")
    ).select(F.col("w.start").alias("start"), "n_users")


def run_available(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    disconnect: Callable[[Exception], bool] | None = None,
) -> StreamingQuery:
    """Run a stream over what is there now, handing each micro-batch to ``each``.

    A failure for which ``disconnect`` is true (a source that asks to be left alone, say) ends the stream quietly; what was written
    before it stays, and the checkpoint lets a later run go on from there. Other failures are raised.
    """
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if not (disconnect and disconnect(e)):
            raise
    return query


def refused(code: int = 420) -> Callable[[Exception], bool]:
    """A rule for ``run_available``: the source answered with this HTTP status."""
    return lambda e: re.search(rf"\bHTTP (status )?{code}\b", str(e)) is not None


def window_report(path: str, estimate: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``run_available``: add ``batch, Time, Truth, Estimation`` of every window that a micro-batch holds to a folder of CSV files.

    ``estimate`` makes ``start, truth, estimate`` of the micro-batch.
    """

    def each(df: DataFrame, batch: int) -> None:
        found = estimate(df).select(F.lit(batch).alias("batch"), F.date_format("start", TIME).alias("Time"), F.col("truth").alias("Truth"), F.col("estimate").alias("Estimation"))
        sinks.append_csv(found, path)

    return each


def sample_report(folder: str, size: int = 100, most: int = 3) -> Callable[[DataFrame, int], None]:
    """For ``run_available`` on ``reservoir``: after every micro-batch, add ``batch, seen, tag, n, rank`` of the sample's commonest tags
    (dense ranks up to ``most``) to ``folder/report``, as CSV.

    The states of all salts are kept in ``folder/states``, one version a micro-batch; the latest ones make the sample.
    """

    def each(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/states")
        states = df.sparkSession.read.parquet(f"{folder}/states").groupBy("salt").agg(F.max_by(F.struct("seen", "sample"), "batch").alias("x"))
        states = states.select("salt", "x.*")
        seen = states.agg(F.sum("seen").alias("seen"))
        ranked = sketch.top_ranks(merged_sample(states, size), "tag", most)
        sinks.append_csv(ranked.crossJoin(seen).select(F.lit(batch).alias("batch"), "seen", "tag", "n", "rank"), f"{folder}/report")

    return each


def run_periodic(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 5, mode: str = "append") -> StreamingQuery:
    """Start a stream that hands over a micro-batch every ``seconds``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(each).start()


def reservoir(rows: DataFrame, size: int = 100, seed: int = 0) -> DataFrame:
    """``seen, sample array<string>`` after each micro-batch: a uniform sample of all ``tag`` so far.

    Kept for each of 8 salts, so that no task sees the whole stream; ``merged_sample`` unites them.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        held = list(held)
        for part in parts:
            for tag in part["tag"]:
                seen += 1
                if len(held) < size:
                    held.append(tag)
                else:
                    at = random.Random(f"{seed}/{key[0]}/{seen}").randrange(seen)
                    if at < size:
                        held[at] = tag
        state.update((seen, held))
        yield pd.DataFrame({"salt": [key[0]], "seen": [seen], "sample": [held]})

    salted = rows.select(F.pmod(F.xxhash64("event_id"), F.lit(8)).alias("salt"), F.col("tag"))
    return salted.groupBy("salt").applyInPandasWithState(
        step, "salt long, seen long, sample array<string>", "seen long, sample array<string>", "update", GroupStateTimeout.NoTimeout
    )


def merged_sample(latest: DataFrame, size: int = 100) -> DataFrame:
    """``tag``: a sample of ``size`` from the latest ``salt, seen, sample``; a held tag stands for its salt's share of the stream."""
    long = latest.select("salt", (F.col("seen") / F.size("sample")).alias("weight"), F.posexplode("sample").alias("at", "tag"))
    key = F.pmod(F.xxhash64("salt", "at"), F.lit(1 << 30)) / float(1 << 30)
    return long.orderBy(F.desc(F.pow(F.greatest(key, F.lit(1e-12)), 1 / F.col("weight"))), "salt", "at").limit(size).select("tag")
