"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups are equal texts (by MD5). A group is placed whole, where the dot product of its demand and the shards' residual capacity is
highest, unless it holds over half a shard's share of some dimension: then its rows are dealt to chunks of about a ``CHUNK``-th of a
shard, which are placed like groups. Demands are in parts of a shard's even share, and a residual may go below zero.

Large groups, of a ``CHUNK``-th of a shard's share or more in some dimension, are placed one after the other, largest first, by the
driver: there are at most ``SHARDS * CHUNK`` of them for each dimension, whatever the corpus. All smaller groups are dealt by hash
to ``PARTS`` tasks; each task places its groups in the same way, largest first, in its share of what the large groups leave of every
shard. A shard is off its share by the last groups of each task, that is by small ones.

Slots follow from the rows that groups bring to a shard: each group has a run of them, and a row's place in the run is its rank in
its group, which is taken cell by cell (``CELL`` rows) in large groups, so no task sorts a shard or a large group.

Defined results: a null text counts as no bytes, has the checksum of the empty text and is grouped with other null texts only;
repeated rows each get a slot; null and repeated ids are placed, as rows are dealt by their own numbers; ties go to the first shard;
long texts count whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.batches import in_batches
from quarry.session import cut

SHARDS = 40
OVERHEAD = 16
CHUNK = 1024
PARTS = 32
CELL = 100_000
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("bytes", "tokens", "rows")


def place_in(residual: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Shard of every item, in their order, by the highest dot product of demand and residual capacity, which is updated."""
    out = np.zeros(len(need), "i4")
    for i, n in enumerate(need):
        k = int((residual @ n).argmax())
        out[i] = k
        residual[k] -= n
    return out


def place(need: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every item, placed largest first, and the residual capacity; ``need``: items x dimensions in parts of a shard's share."""
    order = np.lexsort((np.arange(len(need)), -need.max(axis=1, initial=0)))
    residual = np.ones((shards, need.shape[1]))
    out = np.zeros(len(need), "i4")
    out[order] = place_in(residual, need[order])
    return out, residual


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(text.cast("binary")))).otherwise(F.lit(bytearray())).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )


def placed_small(small: DataFrame, shares: dict[str, float], residual: np.ndarray) -> DataFrame:
    """``group, rows, part, shard, first`` of groups (``group, bytes, tokens, rows``): ``first`` counts the rows that the part put there before."""
    sums = [F.sum(d).alias(d) for d in DIMENSIONS]
    parted = cut(small.withColumn("part", F.pmod(F.xxhash64("group"), F.lit(PARTS)).cast("int")))
    totals = {r["part"]: np.array([r[d] or 0 for d in DIMENSIONS], float) for r in parted.groupBy("part").agg(*sums).collect()}
    whole = np.maximum(sum(totals.values()), 1) if totals else np.ones(len(DIMENSIONS))
    share = np.array([shares[d] for d in DIMENSIONS])
    largest = F.greatest(*[F.col(d) / shares[d] for d in DIMENSIONS])
    ordered = parted.repartition(PARTS, "part").withColumn("largest", largest).sortWithinPartitions("part", F.desc("largest"), "group").drop("largest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, filled = None, residual, np.zeros(len(residual), "i8")
        for batch in batches:
            part, rows = batch.column("part").to_numpy(), batch.column("rows").to_numpy()
            need = np.stack([batch.column(d).to_numpy() for d in DIMENSIONS], axis=1) / share
            where, first = np.zeros(len(part), "i4"), np.zeros(len(part), "i8")
            for p in dict.fromkeys(part.tolist()):
                if p != at:
                    at, left, filled = p, residual * (totals[p] / whole), np.zeros(len(residual), "i8")
                own = np.flatnonzero(part == p)
                where[own] = place_in(left, need[own])
                for i in own:
                    first[i] = filled[where[i]]
                    filled[where[i]] += rows[i]
            columns = [batch.column("group"), batch.column("rows"), batch.column("part"), pa.array(where), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, ["group", "rows", "part", "shard", "first"])

    return in_batches(ordered).mapInArrow(run, "group binary, rows long, part int, shard int, first long")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, tokens, shard, slot`` of every row."""
    rows = cut(measured(docs))
    spark = rows.sparkSession
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = cut(rows.groupBy("group").agg(*sums))
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    shares = {d: max(1, total[d] or 0) / shards for d in DIMENSIONS}
    part = F.greatest(*[F.col(d) / v for d, v in shares.items()])  # of a shard's even share

    large = groups.select("group", part.alias("part")).where(F.col("part") * CHUNK >= 1).orderBy("group").collect()  # bounded: see above
    chunks = [int(np.ceil(r["part"] * CHUNK)) if r["part"] > 0.5 else 1 for r in large]
    starts = np.cumsum([0, *chunks]).tolist()
    listed = [(bytearray(r["group"]), k, b) for r, k, b in zip(large, chunks, starts, strict=False)]
    listed = F.broadcast(spark.createDataFrame(listed, "group binary, chunks long, base long"))
    dealt = rows.join(listed, "group").withColumn("item", F.col("base") + F.pmod(F.xxhash64("row"), F.col("chunks"))).drop("chunks", "base")
    items = dealt.groupBy("item").agg(*sums).orderBy("item").collect()  # bounded: the large groups and the chunks of hot ones
    need = np.array([[r[d] / v for d, v in shares.items()] for r in items], float).reshape(-1, len(shares))
    where, residual = place(need, shards)
    filled = np.zeros(shards, "i8")
    placed = []
    for r, k in zip(items, where.tolist(), strict=True):
        placed.append((r["item"], k, int(filled[k]), -(-r["rows"] // CELL)))
        filled[k] += r["rows"]
    placed = F.broadcast(spark.createDataFrame(placed, "item long, shard int, first long, cells long"))
    celled = dealt.join(placed, "item").withColumn("cell", F.pmod(F.xxhash64("row", F.lit(1)), F.col("cells")))
    before = Window.partitionBy("item").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = celled.groupBy("item", "cell").agg(F.count(F.lit(1)).alias("n")).select("item", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("item", "cell").orderBy("row")) - 1
    slot = F.col("first") + F.col("before") + F.col("rank")
    columns = ["doc_id", "size", "text_crc32", "tokens", "shard"]
    of_large = celled.withColumn("rank", rank).join(offsets, ["item", "cell"]).select(*columns, slot.alias("slot"))

    small = cut(placed_small(groups.join(listed, "group", "left_anti"), shares, residual))
    runs = {(r["part"], r["shard"]): r["n"] for r in small.groupBy("part", "shard").agg(F.sum("rows").alias("n")).collect()}  # PARTS x shards
    bases = []
    for (p, k), n in sorted(runs.items()):
        bases.append((p, k, int(filled[k])))
        filled[k] += n
    bases = F.broadcast(spark.createDataFrame(bases, "part int, shard int, base long"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("row")) - 1
    of_small = rows.join(small.join(bases, ["part", "shard"]).drop("part", "rows"), "group").withColumn("rank", rank)
    return of_large.unionByName(of_small.select(*columns, (F.col("base") + F.col("first") + F.col("rank")).alias("slot")))
