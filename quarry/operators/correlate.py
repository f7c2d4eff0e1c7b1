"""Pearson correlation of all keys over a small universe of items, in dense blocks (see ``blocks``): pairs are kept only where they are asked for."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.operators.itemsets import dense_codes
from quarry.operators.recommend import nearest
from quarry.operators.similarity import LEAST_VARIANCE
from quarry.session import cut


class Rule(NamedTuple):
    """Which pairs count: ``common`` items, a similarity above ``above`` or of at least ``least``, a share of common items among all of
    both, and an equal bucket in one of the first ``bands`` values, if there are such."""

    common: int
    above: float = -np.inf
    least: float = -np.inf
    share: float = 0.0
    bands: int = 0


class Raters(NamedTuple):
    """``sets``: ``id, n, codes, marks`` of each key; ``codes``: ``item, code``."""

    sets: DataFrame
    codes: DataFrame
    width: int


def raters(rated: DataFrame, key: str, by: str, rating: str, codes: DataFrame | None = None) -> Raters | None:
    """Of distinct ``key, by``; None if a join over items is cheaper."""
    rated = rated.where(F.col(key).isNotNull() & F.col(by).isNotNull() & F.col(rating).isNotNull())
    if not blocks.suited(rated, key, by):
        return None
    codes = cut(codes if codes is not None else dense_codes(rated, by)).select(F.col(by).alias("item"), F.col("code").cast("int").alias("code"))
    marked = rated.select(F.col(key).cast("long").alias("id"), F.col(by).alias("item"), F.col(rating).cast("double").alias("mark"))
    listed = marked.join(codes, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("code", "mark"))).alias("_x"))
    sets = listed.select("id", F.lit(1).cast("long").alias("n"), F.transform("_x", lambda x: x["code"]).alias("codes"), F.transform("_x", lambda x: x["mark"]).alias("marks"))
    return Raters(cut(sets), codes, codes.count())


def _correlated(a: blocks.Side, b: blocks.Side, same: bool, width: int, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common items, similarity and whether a pair counts."""
    x, y = a.matrix(width, a.marks, np.float64), b.matrix(width, b.marks, np.float64)
    p, q = a.matrix(width, None, np.float64), b.matrix(width, None, np.float64).T
    n = p @ q
    with np.errstate(all="ignore"):
        mean_x, mean_y = (x @ q) / n, (p @ y.T) / n
        vx, vy = ((x * x) @ q) / n - mean_x * mean_x, (p @ (y * y).T) / n - mean_y * mean_y
        s = np.round(((x @ y.T) / n - mean_x * mean_y) / np.sqrt(vx * vy), 9)
        ok = (n >= rule.common) & (vx > LEAST_VARIANCE) & (vy > LEAST_VARIANCE) & (s > rule.above) & (s >= rule.least)
        if rule.share:
            ok &= n / (a.sizes[:, None] + b.sizes[None, :] - n) >= rule.share
    if rule.bands:
        met = np.zeros(ok.shape, bool)
        place = np.arange(rule.bands)
        u, v = a.values[a.starts[:, None] + place], b.values[b.starts[:, None] + place]
        if min(u.min(initial=0), v.min(initial=0)) >= 0 and max(u.max(initial=0), v.max(initial=0)) < 256:
            u, v = u.astype(np.uint8), v.astype(np.uint8)
        for k in range(rule.bands):
            met |= u[:, k][:, None] == v[:, k][None, :]
        ok &= met
    if same:
        np.fill_diagonal(ok, False)
    return n, s, ok


def pairs(sets: DataFrame, width: int, rule: Rule) -> DataFrame:
    """``a, b, n, similarity`` (a < b)."""

    def kernel(a: blocks.Side, b: blocks.Side, same: bool) -> Iterator[dict[str, np.ndarray]]:
        n, s, ok = _correlated(a, b, same, width, rule)
        i, j = np.nonzero(np.triu(ok) if same else ok)
        u, v = a.ids[i], b.ids[j]
        yield {"a": np.minimum(u, v), "b": np.maximum(u, v), "n": n[i, j].astype(np.int64), "similarity": s[i, j]}

    return blocks.compared(blocks.packed(sets), None, kernel, "a long, b long, n long, similarity double")


def neighbourhoods(sets: DataFrame, width: int, rule: Rule) -> DataFrame:
    """``a, n_neighbours, best`` of keys that have neighbours; no list of them is made."""

    def kernel(a: blocks.Side, b: blocks.Side, same: bool) -> Iterator[dict[str, np.ndarray]]:
        _, s, ok = _correlated(a, b, same, width, rule)
        s = np.where(ok, s, -np.inf)
        for ids, axis in ((a.ids, 1), *([] if same else [(b.ids, 0)])):
            many, best = ok.sum(axis=axis), s.max(axis=axis, initial=-np.inf)
            yield {"a": ids[many > 0], "many": many[many > 0].astype(np.int64), "best": best[many > 0]}

    found = blocks.compared(blocks.packed(sets), None, kernel, "a long, many long, best double")
    return found.groupBy("a").agg(F.sum("many").alias("n_neighbours"), F.max("best").alias("best"))


def near_ratings(sets: DataFrame, asked: DataFrame, width: int, rule: Rule, k: int) -> DataFrame:
    """``user, code, b, similarity, over`` of asked pairs (``id, code``): the ``k`` most similar keys that have the item, ties by the smallest,
    and how far their marks of it lie over their means. Each pair of blocks gives its own ``k`` at most."""
    ask = asked.distinct().groupBy("id").agg(F.collect_list(F.col("code").cast("long")).alias("ask"))
    values = F.col("values") if "values" in sets.columns else F.expr("array()").cast("array<bigint>")
    everyone = sets.withColumn("values", values)
    asking = everyone.join(ask, "id").withColumn("values", F.concat("values", "ask")).drop("ask")

    def kernel(a: blocks.Side, b: blocks.Side, same: bool) -> Iterator[dict[str, np.ndarray]]:
        _, s, ok = _correlated(a, b, same, width, rule)
        ok &= a.ids[:, None] != b.ids[None, :]
        rank = np.empty(len(b.ids), np.int64)
        rank[np.argsort(-b.ids)] = np.arange(len(b.ids))  # the smallest is the greatest
        base = len(b.ids)
        key = np.where(ok, (np.rint(np.where(ok, s, 0) * 1e9).astype(np.int64) + 1_000_000_001) * base + rank, -1)
        has = b.matrix(width, None, np.float32).T > 0
        over = b.matrix(width, b.marks, np.float64).T - (np.add.reduceat(b.marks, np.cumsum(b.sizes) - b.sizes) / b.sizes)[None, :]
        row = np.repeat(np.arange(len(a.ids)), a.many - rule.bands)
        first = np.arange(len(a.values)) - np.repeat(a.starts, a.many) >= rule.bands
        code = a.values[first]
        for at in range(0, len(row), 1024):
            i, c = row[at : at + 1024], code[at : at + 1024]
            found = np.where(has[c], key[i], -1)
            top = np.argpartition(found, max(0, found.shape[1] - k), axis=1)[:, -k:]
            good = np.take_along_axis(found, top, 1) >= 0
            q, _ = np.nonzero(good)
            j = top[good]
            yield {"user": a.ids[i[q]], "code": c[q], "b": b.ids[j], "similarity": s[i[q], j], "over": over[c[q], j]}

    schema = "user long, code long, b long, similarity double, over double"
    # few partitions on the right: a task sees one block on the left with many on the right, and passes on the best of all
    found = blocks.compared(blocks.packed(asking), blocks.packed(everyone).coalesce(4), kernel, schema)
    return nearest(found, ["user", "code"], k)


def predictions(found: DataFrame, rated: DataFrame, codes: DataFrame) -> DataFrame:
    """``user, item, prediction`` of ``near_ratings``: the user's mean and the weighted mean of what lies over the others' means."""
    above = found.groupBy("user", "code").agg((F.sum(F.col("similarity") * F.col("over")) / F.sum("similarity")).alias("above"))
    means = rated.groupBy("user").agg(F.avg("rating").alias("mean"))
    return above.join(codes, "code").join(means, "user").select("user", "item", (F.col("mean") + F.col("above")).alias("prediction"))
