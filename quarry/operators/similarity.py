"""Set similarity by shared-member counts, minhash with banding, and Pearson correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import shift_hash
from quarry.operators import itemsets
from quarry.session import cut

LEAST_VARIANCE = 1e-12


def rarest_first(members: DataFrame, key: str, member: str) -> DataFrame:
    """``k, all``: each key's distinct members, the rarest ones first."""
    members = cut(members.select(F.col(key).alias("k"), F.col(member).alias("m")).distinct())
    ranked = members.join(members.groupBy("m").agg(F.count(F.lit(1)).alias("n")), "m")
    listed = ranked.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "m"))).alias("all"))
    return listed.select("k", F.transform("all", lambda x: x["m"]).alias("all"))


def prefix_pairs(listed: DataFrame, least: Column) -> DataFrame:
    """``a, b, x, y`` (a < b, their members): keys that may share ``least`` members, a number for each key of ``all``.

    Two keys that do share one among the first n - ``least`` + 1 of each (n: members of the key), so only those are joined: with
    the rarest first, hot members are seldom among them.
    """
    listed = cut(listed)
    rare = listed.select("k", F.explode(F.slice("all", F.lit(1), F.greatest(F.lit(0), F.size("all") - least + 1).cast("int"))).alias("m"))
    met = rare.withColumnRenamed("k", "a").join(rare.withColumnRenamed("k", "b"), "m").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    of_a, of_b = listed.select(F.col("k").alias("a"), F.col("all").alias("x")), listed.select(F.col("k").alias("b"), F.col("all").alias("y"))
    return met.join(of_a, "a").join(of_b, "b")


def jaccard(members: DataFrame, key: str, member: str, least: float, candidates: DataFrame | None = None, alike: bool = False) -> DataFrame:
    """``a, b, similarity`` of at least ``least``, which is above 0; of ``candidates`` (``a, b``) only, if given.

    Without candidates only keys that meet in a rare member are compared (see ``prefix_pairs``): a set of n shares at least
    ``least`` * n members with one that is similar enough.
    With ``alike``, members that are in the same keys count once, with their number: for members that are in few keys each.
    """
    if candidates is None:
        met = prefix_pairs(rarest_first(members, key, member), F.greatest(F.lit(1), F.ceil(least * F.size("all") - 1e-9)))
        shared = F.size(F.array_intersect("x", "y"))
        value = shared / (F.size("x") + F.size("y") - shared)
        return met.select("a", "b", value.alias("similarity")).where(F.col("similarity") >= least)
    members = members.select(key, member).distinct().withColumn("w", F.lit(1).cast("long"))
    if alike:
        sets = itemsets.gathered(members.select(F.col(member).alias("basket"), F.col(key).alias("item")))
        numbered = sets.withColumn(member, F.monotonically_increasing_id())
        members = cut(numbered.select(member, "w", F.explode("items").alias(key)))
    size = members.groupBy(key).agg(F.sum("w").alias("n"))
    left = candidates.join(members.select(F.col(key).alias("a"), member), "a")
    both = left.join(members.select(F.col(key).alias("b"), member, "w"), ["b", member])
    pairs = both.groupBy("a", "b").agg(F.sum("w").alias("shared"))
    pairs = pairs.join(size.select(F.col(key).alias("a"), F.col("n").alias("na")), "a")
    pairs = pairs.join(size.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    value = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return pairs.select("a", "b", value.alias("similarity")).where(F.col("similarity") >= least)


def minhash(members: DataFrame, key: str, code: str, modulus: DataFrame, n: int = 160, step: int = 113) -> DataFrame:
    """``key, c, low``: the least of ``(code + step * c) % m`` over a key's members, for c below ``n``; ``modulus``: one row ``m``.

    The minima are taken by partial aggregation over an array for each row of members, so that no key is gathered.
    """
    hashes = [F.min(shift_hash(F.col(code), step, F.lit(c), F.col("m"))).alias(f"h{c}") for c in range(n)]
    wide = members.crossJoin(F.broadcast(modulus)).groupBy(key).agg(*hashes)
    return wide.select(key, F.posexplode(F.array(*[f"h{c}" for c in range(n)])).alias("c", "low"))


def bands(signature: DataFrame, key: str, rows: int, factor: int, offset: int, buckets: int) -> DataFrame:
    """``key, band, bucket`` of signature rows ``key, c, low``."""
    place = F.col("c") % rows
    bucket = (F.sum(F.col("low") * factor * (place + 1)) + offset) % buckets
    return signature.groupBy(key, F.floor(F.col("c") / rows).alias("band")).agg(bucket.alias("bucket"))


def band_candidates(banded: DataFrame, key: str) -> DataFrame:
    """``a, b`` that share a bucket of some band."""
    left, right = banded.withColumnRenamed(key, "a"), banded.withColumnRenamed(key, "b")
    return left.join(right, ["band", "bucket"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def pearson(rated: DataFrame, key: str, by: str, rating: str, least_common: int, candidates: DataFrame | None = None) -> DataFrame:
    """``a, b, n, similarity``: correlation over what both rated, with means over that only; without variance there is none.

    Sums go through decimals, so that they don't depend on the order of rows.
    """
    left = rated.select(F.col(key).alias("a"), by, F.col(rating).alias("x"))
    right = rated.select(F.col(key).alias("b"), by, F.col(rating).alias("y"))
    if candidates is not None:
        left = left.join(candidates, "a")
        pairs = left.join(right, [by, "b"])
    else:
        pairs = left.join(right, by).where(F.col("a") < F.col("b"))
    mean_x, mean_y = F.avg("x"), F.avg("y")
    both = pairs.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.col("x") * F.col("y")) - mean_x * mean_y).alias("cov"),
        (F.avg(F.col("x") * F.col("x")) - mean_x * mean_x).alias("vx"),
        (F.avg(F.col("y") * F.col("y")) - mean_y * mean_y).alias("vy"),
    )
    both = both.where((F.col("n") >= least_common) & (F.col("vx") > LEAST_VARIANCE) & (F.col("vy") > LEAST_VARIANCE))
    value = F.round(F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")), 9)
    return both.select("a", "b", "n", value.alias("similarity"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Symmetric ``a, b, similarity``."""
    there = pairs.select("a", "b", "similarity")
    return there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
