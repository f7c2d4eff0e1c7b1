"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors of a label are one node. Nodes of a label are put in overlapping shards: around centroids fitted to a sample of
``SAMPLE`` nodes a group, every node goes to its nearest centroid and to every other one whose cell the cone of ``least`` around the
node can reach, so that the shard of a node's nearest centroid holds all that the node may be linked with; groups
too large for a shard are divided again. A group that centroids do not separate (more than ``COPIES`` copies a node, or more than half of the
comparisons left) is compared exactly, by pairs of salted blocks, in time that grows with the square of its size. Each shard gives its nodes' adjacency lists: near nodes, robustly pruned (one is dropped if another
kept one is ``ALPHA`` times nearer to it than the node is), with edges both ways; the lists of all shards are united.
Then every node is searched from the medoid of the shard of its nearest centroid, which also holds what its cone reaches from other cells: greedy search with a beam, then range expansion from what was found
in range until nothing new is in range. Edges to other shards are not followed: what is in range of a node is in its shard. Every shard audits its recall on a sample of its nodes against brute force, and
searches again with a wider beam while it misses too much, at last exactly. A label of several shards is audited, too: a sample of its
nodes against all of its vectors, in blocks; one that misses too much is compared exactly. All cosines are in double precision, so links are verified by
construction.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without label, are linked with
nothing; vectors of different dimensions are never linked; equal vectors are linked with each other; rows that share an id
are vectors of their own, with the smallest id of their component; a null id is kept, and its component is null; an empty table
gives no rows; other columns, whatever their names, are not read; components are read as doubles unless they are floats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.unionfind import components, local_components
from quarry.session import cut

LEAST_COSINE = 0.98
#: Nodes of a shard, about; a group of more than twice as many is divided. Centroids and sampled nodes of a division.
SHARD, CENTROIDS, SAMPLE = 1500, 64, 2048
#: A group is divided if its nodes get no more copies than this on average, and no more than this share of comparisons is left.
COPIES, LEFT = 2, 0.5
#: Cosines may be rounded by so much.
SLACK = 1e-9
LEVELS = 6
#: Nodes of a salted block, about.
BLOCK = 4096
NEAR, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 32
AUDITED, LEAST_RECALL, WIDEST = 64, 0.97, 256
#: Groups whose centroids (32 kB each) are broadcast at once; more are joined by a shuffle.
BROADCAST_GROUPS = 256


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows; a centroid without members keeps its place."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for i in range(k):
            m = x[near == i]
            if len(m) and np.linalg.norm(s := m.sum(axis=0)) > 1e-12:
                c[i] = s / np.linalg.norm(s)
    return c


def reached(x: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
    """Which centroids' cells can hold a vector whose cosine with a row is ``least`` or more: none of the others by a bisector."""
    sim = x @ c.T
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)
    sine = np.sqrt(1 - least * least) if least > 0 else 2.0
    return np.stack([(sim - sim[:, [j]] <= sine * apart[j] + SLACK).all(axis=1) for j in range(len(c))], axis=1)


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of each row: robustly pruned near rows, and edges back."""
    n = len(x)
    near = min(NEAR, n - 1)
    if near <= 0:
        return [np.empty(0, np.int64) for _ in range(n)]
    sources, targets = [], []
    for at in range(0, n, 512):
        own = np.arange(at, min(n, at + 512))
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -2
        cand = np.argpartition(-sim, near - 1, axis=1)[:, :near]
        cs = np.take_along_axis(sim, cand, axis=1)
        order = np.argsort(-cs, axis=1)
        cand, cs = np.take_along_axis(cand, order, axis=1), np.take_along_axis(cs, order, axis=1)
        reach = np.sqrt(np.maximum(0, 2 - 2 * cs))
        v = x[cand]
        among = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
        open_, keep = np.ones(cand.shape, bool), np.zeros(cand.shape, bool)
        for r in range(near):
            take = open_[:, r] & (keep.sum(axis=1) < DEGREE)
            keep[:, r] = take
            open_ &= ~(take[:, None] & (ALPHA * among[:, r] <= reach))
        rows, cols = np.nonzero(keep)
        sources.append(own[rows])
        targets.append(cand[rows, cols])
    a, b = np.concatenate(sources), np.concatenate(targets)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    both = np.unique(a * n + b)
    a, b = both // n, both % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def search(x: np.ndarray, neighbours: list[np.ndarray], queries: np.ndarray, beam: int, least: float) -> np.ndarray:
    """Pairs (query, row) with a cosine of at least ``least``, as found from the medoid; queries are rows of ``x``."""
    n = len(x)
    widest = max(1, max(map(len, neighbours)))
    near = np.full((n, widest), -1)
    for i, b in enumerate(neighbours):
        near[i, : len(b)] = b
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    found = []
    for at in range(0, len(queries), 512):
        q = queries[at : at + 512]
        m = len(q)
        line = np.arange(m)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1)
        sims = np.full((m, beam), -2.0)
        done = np.ones((m, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        seen[:, medoid] = True
        hits = [np.stack([line, ids[:, 0]])[:, sims[:, 0] >= least]]
        while True:
            at_best = np.where(done, -3.0, sims).argmax(axis=1)
            active = np.flatnonzero(~done[line, at_best])
            if not len(active):
                break
            node = ids[active, at_best[active]]
            done[active, at_best[active]] = True
            new = near[node]
            fresh = (new >= 0) & ~seen[active[:, None], new]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            qi, v = active[r], new[r, c]
            seen[qi, v] = True
            s = np.einsum("ij,ij->i", x[q[qi]], x[v])
            hits.append(np.stack([qi, v])[:, s >= least])
            more = np.full((len(active), widest), -2.0)
            more[r, c] = s
            all_sims = np.concatenate([sims[active], more], axis=1)
            all_ids = np.concatenate([ids[active], new], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, best, axis=1)
            ids[active] = np.take_along_axis(all_ids, best, axis=1)
            done[active] = np.take_along_axis(all_done, best, axis=1) | (sims[active] < -1.5)
        front = np.concatenate(hits, axis=1)
        found.append(np.stack([q[front[0]], front[1]]))
        while front.shape[1]:  # range expansion
            news = []
            for part in range(0, front.shape[1], 8192):
                fq, fv = front[:, part : part + 8192]
                new = near[fv]
                key = np.unique((fq[:, None] * n + new)[(new >= 0) & ~seen[fq[:, None], new]])
                qi, v = key // n, key % n
                seen[qi, v] = True
                s = np.einsum("ij,ij->i", x[q[qi]], x[v])
                news.append(np.stack([qi, v])[:, s >= least])
            front = np.concatenate(news, axis=1)
            found.append(np.stack([q[front[0]], front[1]]))
    pairs = np.concatenate(found, axis=1)
    return pairs[:, pairs[0] != pairs[1]]


def audited(x: np.ndarray, neighbours: list[np.ndarray], queries: np.ndarray, least: float) -> np.ndarray:
    """``search`` of the queries, with a beam wide enough for the recall asked on a sample of them against brute force; exact if none is."""
    n, beam = len(x), min(BEAM, max(1, len(x)))
    if not len(queries):
        return np.empty((2, 0), np.int64)
    sample = queries[np.unique(np.linspace(0, len(queries) - 1, AUDITED).astype(int))]
    truth = x[sample] @ x.T >= least
    truth[np.arange(len(sample)), sample] = False
    while True:
        pairs = search(x, neighbours, queries, beam, least)
        mine = np.isin(pairs[0], sample)
        if mine.sum() >= LEAST_RECALL * truth.sum():
            return pairs
        if beam >= min(WIDEST, n):
            break
        beam = min(2 * beam, WIDEST, n)
    found = []
    for at in range(0, len(queries), 512):
        u, v = np.nonzero(x[queries[at : at + 512]] @ x.T >= least)
        found.append(np.stack([queries[at + u], v]))
    pairs = np.concatenate(found, axis=1)
    return pairs[:, pairs[0] != pairs[1]]


def exact_links(x: np.ndarray, times: np.ndarray, rows: np.ndarray, cols: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Times of all that each row is linked with, and the smallest row reachable, by all pairs of ``rows`` with ``cols`` or, without these, with each other."""
    n = len(x)
    others, root = np.zeros(n, np.int64), np.arange(n)
    against = rows if cols is None else cols
    y = x[against]
    for at in range(0, len(rows), 256):
        own = rows[at : at + 256]
        near = x[own] @ y.T >= least
        if cols is None:
            near[np.arange(len(own)), at + np.arange(len(own))] = False
        u, v = np.nonzero(near)
        u, v = own[u], against[v]
        others += np.bincount(u, times[v], n).astype(np.int64)
        if cols is not None:
            others += np.bincount(v, times[u], n).astype(np.int64)
        pairs = np.stack([root[u], root[v]])
        pairs = pairs[:, pairs[0] != pairs[1]]
        if pairs.shape[1]:
            root = local_components(n, pairs)[root]
    return others, root


def good_vector() -> F.Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False)) & F.col("label").isNotNull()


def centres(groups: DataFrame, level: int, least: float) -> DataFrame:
    """``shard, centroids, separates`` of groups (``shard, node, vector, n``), fitted and tried on a sample of each."""
    order = Window.partitionBy("shard").orderBy(F.xxhash64("node", F.lit(level)), "node")
    # each partition keeps no more than the sample of a group before the exchange
    sample = groups.select("shard", "node", "vector", "n").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= SAMPLE)

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        k = int(min(CENTROIDS, -(-part["n"].iloc[0] // SHARD), len(part)))
        x = unit(part.sort_values("_at")["vector"].tolist())
        c = fit_centroids(x, k)
        copies = reached(x, c, least)
        own = np.bincount((x @ c.T).argmax(axis=1), minlength=k)
        separates = copies.sum() <= COPIES * len(x) and (own * copies.sum(axis=0)).sum() <= LEFT * len(x) ** 2
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "centroids": [[list(map(float, v)) for v in c]], "separates": [bool(separates)]})

    return cut(sample.groupBy("shard").applyInPandas(centroids, "shard string, centroids array<array<double>>, separates boolean"))


def divided(groups: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """``node, times, vector, own, shard`` of nodes in groups that are too large, each in all parts of its group that it can have links in."""

    def assign(batches):
        for part in batches:
            out = []
            for shard, rows in part.groupby("shard"):
                c = np.array([np.asarray(v) for v in rows["centroids"].iloc[0]])
                x = unit(rows["vector"].tolist())
                first = (x @ c.T).argmax(axis=1)
                copies = reached(x, c, least)
                copies[np.arange(len(x)), first] = True
                at, to = np.nonzero(copies)
                piece = rows[["node", "times", "vector", "own"]].iloc[at].copy()
                piece["own"] = piece["own"].to_numpy() & (to == first[at])
                piece["shard"] = [f"{shard}.{i}" for i in to]
                out.append(piece)
            if out:
                yield pd.concat(out)[["node", "times", "vector", "own", "shard"]]

    joined = groups.join(made, "shard").select("node", "times", "vector", "own", "shard", "centroids")
    kind = groups.schema["vector"].dataType.simpleString()
    return joined.mapInPandas(assign, f"node long, times long, vector {kind}, own boolean, shard string")


def shards(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``node, times, vector, shard, own``: overlapping shards of ``nodes`` (``node, times, vector, shard``: first by label), and
    groups that no centroids separate, or not in ``LEVELS`` levels.

    ``own`` marks the one shard of a node that its nearest centroids lead to: it is searched from there.
    """
    open_ = nodes.withColumn("own", F.lit(True))
    final = dense = open_.limit(0)
    for level in range(LEVELS):
        sizes = open_.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        sized = cut(open_.join(sizes, "shard"))
        final = final.unionByName(sized.where(F.col("n") <= 2 * SHARD).drop("n"))
        large = sized.where(F.col("n") > 2 * SHARD)
        if large.isEmpty():
            return final, dense
        made = centres(large, level, least)
        if made.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
            made = F.broadcast(made)
        dense = dense.unionByName(large.join(made.where(~F.col("separates")).select("shard"), "shard").drop("n"))
        open_ = cut(divided(large, made.where("separates"), least))
    return final, dense.unionByName(open_)


def compared(members: DataFrame, least: float) -> DataFrame:
    """``shard, node, own, root, others``, partly, of groups in which every pair of salted blocks is compared."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    salted = members.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = salted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node").reset_index(drop=True)
        ids, first = part["node"].to_numpy(), (part["block"] == part["low"]).to_numpy()
        alone = part["low"].iloc[0] == part["high"].iloc[0]
        cols = None if alone else np.flatnonzero(~first)
        others, root = exact_links(unit(part["vector"].tolist()), part["times"].to_numpy(), np.flatnonzero(first), cols, least)
        return pd.DataFrame({"shard": part["shard"], "node": ids, "own": part["own"], "root": ids[root], "others": others})

    return spread.groupBy("shard", "low", "high").applyInPandas(compare, "shard string, node long, own boolean, root long, others long")


def group() -> F.Column:
    """The group (label and dimension) that a shard is a part of."""
    return F.regexp_extract("shard", r"(?s)^(.*:-?\d+)(?:\.\d+)*$", 1)


def missed(nodes: DataFrame, members: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """``shard`` of the groups (of ``nodes``) whose shards' search misses too much, by a sample against all vectors of the group."""
    order = Window.partitionBy("group").orderBy(F.xxhash64("node", F.lit(LEVELS)), "node")
    own = members.where("own").withColumn("group", group()).where(F.col("shard") != F.col("group"))
    sample = own.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= AUDITED)
    sample = cut(sample.select(F.col("group").alias("shard"), "node", "times", "vector"))
    sizes = nodes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).join(sample.select("shard").distinct(), "shard")
    every = nodes.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
    asked = sample.join(sizes, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    columns = ["shard", "block", "node", "times", "vector"]
    both = every.select(*columns, F.lit(False).alias("asked")).unionByName(asked.select(*columns, F.lit(True).alias("asked")))

    def truth(part: pd.DataFrame) -> pd.DataFrame:
        q, rest = part[part["asked"]], part[~part["asked"]]
        if not len(rest):
            return pd.DataFrame({"shard": q["shard"], "node": q["node"], "true": np.zeros(len(q), np.int64)})
        near = unit(q["vector"].tolist()) @ unit(rest["vector"].tolist()).T >= least
        near &= q["node"].to_numpy()[:, None] != rest["node"].to_numpy()
        return pd.DataFrame({"shard": q["shard"], "node": q["node"], "true": near @ rest["times"].to_numpy()})

    true = both.groupBy("shard", "block").applyInPandas(truth, "shard string, node long, true long")
    true = true.groupBy("shard", "node").agg(F.sum("true").alias("true")).join(counts, "node", "left")
    recall = true.groupBy("shard").agg(F.sum(F.least("true", F.coalesce("others", F.lit(0)))).alias("found"), F.sum("true").alias("true"))
    return cut(recall.where(F.col("found") < LEAST_RECALL * F.col("true")).select("shard"))


def near_duplicates(table: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``."""
    kind = "array<float>" if table.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = cut(
        table.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), "label").withColumn(
            "good", good_vector() & F.col("vec_id").isNotNull()
        )
    )
    good = rows.where("good").select("vec_id", F.col("embedding").alias("vector"), F.concat_ws(":", F.col("label").cast("string"), F.size("embedding")).alias("shard"))
    nodes = cut(good.groupBy("shard", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("times")))
    members, dense = shards(nodes.select("node", "times", "vector", "shard"), least)
    members, exact = cut(members), cut(compared(dense, least))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["node"].to_numpy()
        lists = [ids[b].tolist() for b in pruned(unit(part["vector"].tolist()))]
        return pd.DataFrame({"node": ids, "near": lists})

    lists = members.groupBy("shard").applyInPandas(build, "node long, near array<long>")
    graph = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node").reset_index(drop=True)
        ids, times = part["node"].to_numpy(), part["times"].to_numpy()
        x = unit(part["vector"].tolist())
        adjacent = []
        for near in part["near"]:
            at = np.searchsorted(ids, near)
            at = at[at < len(ids)] if len(at) else at
            near = np.asarray(near)[: len(at)] if len(near) == len(at) else np.asarray([v for v in near if v <= ids[-1]])
            adjacent.append(at[ids[at] == near].astype(np.int64))
        pairs = audited(x, adjacent, np.flatnonzero(part["own"].to_numpy()), least)
        pairs = np.concatenate([pairs, pairs[::-1]], axis=1)  # a link found from one side holds for both
        key = np.unique(pairs[0] * len(ids) + pairs[1])
        pairs = np.stack([key // len(ids), key % len(ids)])
        root = local_components(len(ids), pairs)
        edges = np.searchsorted(pairs[0], np.arange(len(ids) + 1))
        linked = [pairs[1, edges[i] : edges[i + 1]] for i in range(len(ids))]
        return pd.DataFrame(
            {
                "node": ids,
                "root": ids[root],
                "linked": [ids[b] for b in linked],
                "times": [times[b] for b in linked],
            }
        )

    walked = members.join(graph, "node").groupBy("shard").applyInPandas(
        walk, "node long, root long, linked array<long>, times array<long>"
    )
    walked = cut(walked)
    # a node of several shards has the union of its links; each carries how many rows the other node stands for
    found = walked.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("linked", "times")))).alias("x"))
    counts = found.select("node", F.aggregate("x", F.lit(0).cast("long"), lambda s, y: s + y["times"]).alias("others"))
    again = missed(nodes.select("shard", "node", "times", "vector"), members, counts, least)
    if not again.isEmpty():
        redone = nodes.select("shard", "node", "times", "vector").join(again, "shard").withColumn("own", F.lit(True))
        kept = exact.withColumn("group", group()).join(again.withColumnRenamed("shard", "group"), "group", "left_anti").drop("group")
        exact = cut(kept.unionByName(compared(redone, least)))
    whole = exact.where("own").groupBy("node").agg(F.sum("others").alias("whole"))
    links = walked.select("node", "root").unionByName(exact.select("node", "root"))
    parts = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    described = nodes.join(counts, "node", "left").join(whole, "node", "left").join(parts, "node", "left").select(
        "shard",
        "vector",
        (F.coalesce("whole", "others", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    plain = rows.where("good").select("vec_id", F.col("embedding").alias("vector"), F.concat_ws(":", F.col("label").cast("string"), F.size("embedding")).alias("shard"))
    linked = plain.join(described, ["shard", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
