"""Sketches: Bloom membership, Flajolet-Martin counts, bottom-k samples, dense top ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import bytes_modulo, trailing_zeros

HASHES = 10


def bloom_size(n_items: int, hashes: int = HASHES) -> tuple[int, int]:
    """Bits of the filter, and the step between its hash functions."""
    import math

    bits = max(1, int(hashes * n_items / math.log(2)))
    return bits, bits // hashes


def bloom_places(text: Column, bits: int, step: int, hashes: int = HASHES) -> Column:
    base = bytes_modulo(text, bits)
    return F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda i: (base + step * i) % bits)


def bloom_bits(items: DataFrame, column: str, bits: int, step: int) -> DataFrame:
    """``place``: the bits that are set."""
    return items.where(F.col(column) != "").select(F.explode(bloom_places(F.col(column), bits, step)).alias("place")).distinct()


def bloom_probe(rows: DataFrame, column: str, filled: DataFrame, bits: int, step: int) -> DataFrame:
    """Every row with ``prediction`` 1 if all its bits are set; empty and null values are 0.

    Distinct values are probed, not rows, so hot values cost as much as rare ones.
    """
    values = rows.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    asked = values.select(column, F.explode(F.array_distinct(bloom_places(F.col(column), bits, step))).alias("place"))
    hit = asked.join(filled.withColumn("_set", F.lit(1)), "place", "left").groupBy(column).agg(F.min(F.coalesce("_set", F.lit(0))).alias("_all"))
    return rows.join(hit, column, "left").withColumn("prediction", F.coalesce("_all", F.lit(0))).drop("_all")


def bloom_filter(items: DataFrame, column: str, n: int, false_rate: float = 0.01):
    """The engine's own sketch, for production: one small object that any executor can probe."""
    return items._jdf.stat().bloomFilter(column, n, false_rate)


def fm_estimate(rows: DataFrame, keys: list[str], code: Column, groups: int = 8, per_group: int = 9, modulus: int = 997) -> DataFrame:
    """``keys, truth, estimate``: distinct values by trailing zeros of ``groups * per_group`` hashes.

    Estimate: median over groups of the mean over a group's hashes of 2 to the power of the most zeros seen.
    """
    coded = rows.select(*keys, code.alias("_v")).distinct()  # repeated values change neither count nor maxima
    maxima = []
    for g in range(groups):
        for h in range(per_group):
            hashed = (F.col("_v") * (2 * g + 3) + 17 * (h + 1) + 131 * g) % (modulus + 10 * g)
            maxima.append(F.max(trailing_zeros(hashed)).alias(f"m{g}_{h}"))
    found = coded.groupBy(*keys).agg(F.count("_v").alias("truth"), *maxima)
    means = F.array(*[sum((F.pow(F.lit(2.0), F.col(f"m{g}_{h}")) for h in range(1, per_group)), F.pow(F.lit(2.0), F.col(f"m{g}_0"))) / per_group for g in range(groups)])
    ordered = F.array_sort(means)
    middle = (F.element_at(ordered, groups // 2) + F.element_at(ordered, groups // 2 + 1)) / 2 if groups % 2 == 0 else F.element_at(ordered, groups // 2 + 1)
    return found.select(*keys, "truth", F.round(middle, 6).alias("estimate"))


def bottom_k(rows: DataFrame, order: Column, k: int) -> DataFrame:
    """The ``k`` rows of the smallest ``order``: with a hash, a uniform sample that doesn't depend on partitions."""
    return rows.orderBy(order).limit(k)


def top_ranks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``key, n, rank``: keys of the ``most`` highest counts, with all ties. The window is over distinct keys."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n")))).where(F.col("rank") <= most)
