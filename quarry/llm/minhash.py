"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is ``SYMBOLS`` symbols of ``BITS`` bits each (b-bit minhash); the distance of two is the number
of symbols that differ. ``reach`` is the largest distance that a pair of the wanted similarity has but for one in
``MISSED`` such pairs. By the pigeonhole principle, of the signature's chunks of ``CHUNK`` symbols at most ``reach // 2``
can hold two errors or more, so that in any ``reach // 2 + 1`` chunks one holds at most one error: those chunks are
indexed under every pattern of one allowed error, and all pairs within reach share an index key. Pairs of a key
are not all compared: every member meets the key's first member, what links (by exact sets) is united, and only pairs
between different components are then compared by signature, keys with the same members once. Keys with many members are cut in
salted blocks, and each pair of blocks is compared by its own task.
Every link is confirmed on full shingle sets, which come along with the members, nearest pairs first; pairs that are united by then
need no confirmation, so no list of pairs leaves a task.

Documents with equal sets are one node; a hot text costs a partial minimum. No text or signature goes to the driver.

Defined results: null texts and texts without words have no shingles and are linked with nothing; null ids likewise, with a
null component, and they are kept; rows that share an id count as one document; an empty table gives no rows; columns other
than id and text, whatever their names, are not read; long texts are shingled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import shingles as S
from quarry.llm.batches import by_groups, in_batches, tidy
from quarry.llm.unionfind import components, local_components
from quarry.session import cut

CHUNK = 4
CHUNKS = S.SYMBOLS // CHUNK
MISSED = 100_000
#: Members of a key, and shingles of their sets, that are compared with each other in one piece; more are cut in blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Bits of the bitmap that spares most texts the way through an exchange, as a power of two.
SIEVE = 22


def reach(percent: int) -> int:
    """The largest distance to look for: odd, and passed by under 1 in ``MISSED`` pairs of this similarity."""
    p, tail, most = 1 - percent / 100, 1.0, -1
    while tail > 1 / MISSED:
        most += 1
        tail -= comb(S.SYMBOLS, most) * p**most * (1 - p) ** (S.SYMBOLS - most)
    return most | 1


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, print binary, signature binary``; the print is 128 bits of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, signs = [], [], []
            for found in S.sets(batch.column(1).to_pylist()):
                n.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(S.signature(found).tobytes() if len(found) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "signature"])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run, S.forget), "doc_id long, n_shingles long, print binary, signature binary")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, S.SYMBOLS)


def _chunk_keys(symbols: np.ndarray, chunks: list[int]) -> np.ndarray:
    """Rows x (chunks x CHUNK) keys: which chunk, which symbol is left out, and the symbols that remain."""
    out = np.empty((len(symbols), len(chunks) * CHUNK), np.int64)
    for a, c in enumerate(chunks):
        part = symbols[:, c * CHUNK : (c + 1) * CHUNK].astype(np.int64)
        for skip in range(CHUNK):
            key = np.full(len(symbols), c * CHUNK + skip, np.int64)
            for k in range(CHUNK):
                if k != skip:
                    key = key << S.BITS | part[:, k]
            out[:, a * CHUNK + skip] = key
    return out


def index(nodes: DataFrame, chunks: list[int]) -> DataFrame:
    """``key, node`` under every chunk and allowed error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, len(batch), 2000)):
                keys = _chunk_keys(_symbols(part.column(1)), chunks)
                node = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return in_batches(nodes.select("node", "signature")).mapInArrow(tidy(run), "key long, node long")


def near_pairs(part: np.ndarray, n: np.ndarray, symbols: np.ndarray, most: int, percent: int) -> Iterator[np.ndarray]:
    """Pairs of rows of different components, within reach and of sizes that allow the similarity, and their distance; block by block."""
    for i in range(0, len(part), BLOCK):
        for j in range(0, i + 1, BLOCK):
            x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
            want = part[x, None] != part[None, y]
            want &= 100 * np.minimum(n[x, None], n[None, y]) >= percent * np.maximum(n[x, None], n[None, y])
            if i == j:
                want &= np.tri(*want.shape, -1, dtype=bool)
            r, c = np.nonzero(want)
            for at in range(0, len(r), 1 << 17):
                rr, cc = r[at : at + (1 << 17)] + i, c[at : at + (1 << 17)] + j
                apart = (symbols[rr] != symbols[cc]).sum(axis=1)
                near = apart <= most
                yield np.stack([rr[near], cc[near], apart[near]])


def shared(sets: list[np.ndarray], a: int, b: int) -> int:
    """Hashes that two sorted sets have in common."""
    x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def united(root: np.ndarray, pairs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Those of ``pairs`` (rows and distance) that are similar on full sets, enough to unite all that any of them would.

    ``root``: what is united already. In rounds, the nearest pair still open between any two components is confirmed or dropped.
    """
    found: list[tuple[int, int]] = []
    pairs = pairs[:, np.lexsort((pairs[0], pairs[1], pairs[2]))]
    while pairs.shape[1]:
        x, y = root[pairs[0]], root[pairs[1]]
        pairs, x, y = pairs[:, x != y], x[x != y], y[x != y]
        first = np.unique(np.minimum(x, y) * len(root) + np.maximum(x, y), return_index=True)[1]
        new = []
        for i in first:
            a, b = int(pairs[0, i]), int(pairs[1, i])
            n = shared(sets, a, b)
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                new.append((a, b))
        pairs = np.delete(pairs, first, axis=1)
        if new:
            found += new
            root = local_components(len(root), np.stack([root[[a for a, _ in new]], root[[b for _, b in new]]]))[root]
    return found


def compared(members: DataFrame, most: int, percent: int) -> DataFrame:
    """``a, b`` (a > b): links that unite the similar members of each group, beyond their components.

    ``members``: ``g, part, node, component, n_shingles, signature, set``, each group's rows together in one partition.
    """

    def links(table: pa.Table) -> pa.RecordBatch:
        g, part = table.column("g").to_numpy(), table.column("part").to_numpy()
        edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(part) != 0)) + 1
        node, first, row = np.unique(table.column("node").to_numpy(), return_index=True, return_inverse=True)
        component, n = (table.column(c).to_numpy()[first] for c in ("component", "n_shingles"))
        own = table.take(pa.array(first))
        symbols = _symbols(own.column("signature"))
        sets = [np.frombuffer(x, np.uint64) for x in own.column("set").to_pylist()]
        near = [
            np.stack([np.maximum(at[p[0]], at[p[1]]), np.minimum(at[p[0]], at[p[1]]), p[2]])
            for at in (row[lo:hi] for lo, hi in zip([0, *edges], [*edges, len(g)], strict=True))
            for p in near_pairs(component[at], n[at], symbols[at], most, percent)
        ]
        pairs = np.concatenate(near, axis=1) if near else np.empty((3, 0), np.int64)
        key, at = np.unique(pairs[0] * len(node) + pairs[1], return_index=True)
        root = np.unique(component, return_inverse=True)[1]
        root = np.unique(component, return_index=True)[1][root]  # a row of each component stands for it
        found = united(root, pairs[:, at], sets, percent)
        a, b = (np.array([node[p[k]] for p in found], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return in_batches(members.select("g", "part", "node", "component", "n_shingles", "signature", "set")).mapInArrow(
        tidy(by_groups(links)), "a long, b long"
    )


def within_reach(pairs: DataFrame, nodes: DataFrame, most: int, percent: int) -> DataFrame:
    """Those of ``a, b`` whose signatures and set sizes allow the similarity."""
    of_a = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    of_b = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(of_a, "a").join(of_b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(axis=1) <= most
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return in_batches(both.select("a", "b", "sa", "sb")).mapInArrow(tidy(run), "a long, b long")


def sieve_places(node: np.ndarray) -> np.ndarray:
    return (S.mix(node.astype(np.uint64)) >> np.uint64(64 - SIEVE)).astype(np.int64)


def sieve_of(nodes: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** SIEVE`` bits that is set for every node and, by chance, for some others: of fixed size, so it may go
    everywhere; what it lets through in error, the join behind it drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE, bool)
        for batch in batches:
            bits[sieve_places(batch.column(0).to_numpy())] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "bits"])

    merged = nodes.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << SIEVE - 6, np.int64)
    out[merged.column("at").to_numpy()] = merged.column("bits").to_numpy()
    return out.view(np.uint8)


def full_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, set`` of those nodes; ``texts``: ``node, text``."""
    sieve = sieve_of(nodes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).fill_null(0).to_numpy()
            at = sieve_places(node)
            batch = batch.filter(pa.array(sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            found = [s.tobytes() for s in S.sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "set"])

    return in_batches(texts).mapInArrow(tidy(make, S.forget), "node long, set binary").join(nodes, "node", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``a, b`` with 100 * intersection >= percent * union of their full sets; ``texts``: ``node, text``."""
    full = full_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    of_a = full.select(F.col("node").alias("a"), F.col("set").alias("x"))
    of_b = full.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return in_batches(both).mapInArrow(tidy(run), "a long, b long")


def labelled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    return nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def links(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between nodes, enough to give the components of all confirmed links."""
    most = reach(percent)
    bad = most // 2
    if bad + 1 > CHUNKS:
        raise ValueError("the similarity is too low for this signature")
    chunks = list(range(bad + 1))
    texts = docs.select(F.col("doc_id").alias("node"), "text")

    keys = index(nodes, chunks)
    stars = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_last")).where(F.col("b") < F.col("_last"))
    shared = cut(keys.join(stars.select("key", "b"), "key"))  # only keys with two members or more
    starred = shared.where(F.col("node") > F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    first = cut(confirmed(cut(within_reach(starred, nodes, most, percent)), texts, percent))

    parts = cut(labelled(nodes, components(first)))
    known = shared.join(parts.select("node", "component", "n_shingles"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks)
    mixed = mixed.where(F.col("lo") < F.col("hi")).select("key", "blocks")
    members = cut(shared.join(mixed, "key").select("key", "node", "blocks"))
    groups = cut(together(members.where(F.col("blocks") == 1)).unionByName(block_pairs(members.where(F.col("blocks") > 1))))
    detail = parts.select("node", "component", "n_shingles", "signature")
    full = full_sets(texts, groups.select("node").distinct())
    ready = groups.join(detail.join(full, "node"), "node").repartition("g", "part").sortWithinPartitions("g", "part")
    return first.unionByName(compared(ready, most, percent))


def together(members: DataFrame) -> DataFrame:
    """``g, part, node``: keys with the same members are one group."""
    sets = members.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()  # a block at most
    return sets.select(F.xxhash64("nodes").alias("g"), F.lit(0).cast("long").alias("part"), F.explode("nodes").alias("node"))


def block_pairs(members: DataFrame) -> DataFrame:
    """``g, part, node``: each pair of a key's salted blocks is a group."""
    salted = members.select("key", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    spread = salted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where(F.col("block") != F.col("other"))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return spread.select(F.col("key").alias("g"), pair.alias("part"), "node")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; linked from ``percent`` hundredths of similarity on."""
    signs = cut(signatures(docs))
    some = signs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = cut(
        some.groupBy("print", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    )
    parts = components(links(docs, nodes, percent))
    parts = labelled(nodes.select("print", "node"), parts).select("print", "component")
    out = signs.join(parts, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )
