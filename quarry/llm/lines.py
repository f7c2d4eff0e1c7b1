"""Fuzzy line deduplication: minhash of character shingles, banding, exact Jaccard, distributed union-find.

A line is what stands between line feeds; lines without a word (``[^\\x20\\x09-\\x0D]+``) are left alone. Lines are compared in
lower case, with runs of white space as one space. Equal lines are one node, by a 128-bit print. A node's set holds its
``WIDTH``-character shingles, all of them, or the whole line if it is shorter. One hash of each shingle, sorted into ``BINS`` bins
of which each keeps its least value, gives the signature (empty bins borrow from the next one); ``BANDS`` bands of ``ROWS`` bins
are the keys. All lines of a key are compared by the Jaccard similarity of their whole sets, which is counted on hashes and, near the
threshold, once more on the shingles themselves. What is linked is united; of every component the line with the smallest
(document id, place) stays, all others go.

No hot line is ever gathered: occurrences are reduced to their smallest place by partial minima, and documents are joined with the
places that stay. Keys with the same members are compared once. Keys with more than ``BLOCK`` members or ``BLOCK_CHARACTERS`` are cut
in salted blocks, and each pair of blocks is compared by its own task.

Defined results: null and empty texts stay as they are; documents with a null id take no part and stay; a document whose
lines all go is left with an empty text; of documents that share an id a line stays if it stays for any of them; ties (equal or
linked lines) go to the smallest document id, then the first place; long texts and long lines are taken whole; an empty
table gives no rows; other columns, whatever their names, pass through and never enter Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.batches import by_groups, fresh, in_batches, tidy
from quarry.llm.minhash import sieve_of, sieve_places
from quarry.llm.shingles import mix, sorted_distinct
from quarry.llm.unionfind import components, local_components
from quarry.session import cut

WIDTH = 8
BINS, ROWS = 48, 4
BANDS = BINS // ROWS
PERCENT = 80
#: Characters whose shingles are hashed together: few enough for a processor's cache.
PORTION = 1 << 14
#: Lines and characters of a block; a task compares two of them at most.
BLOCK, BLOCK_CHARACTERS = 1024, 1 << 20
#: Lines of groups of up to so many members are compared pair by pair, of larger ones by a product of incidence matrices.
FEW = 12
HASH = 44
SPACE = " \t\n\x0b\f\r"
_random = np.random.default_rng(20240307)
PLACE = _random.integers(1, 1 << 62, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal_lines(text: str) -> list[bytes]:
    """The normalised lines of a text; those without a word are empty."""
    return [b" ".join(x.split()) for x in text.lower().encode().split(b"\n")]


def line_print(line: bytes) -> bytes:
    """128-bit print of a normalised line."""
    return xxhash.xxh3_128_digest(line)


def portions(size: np.ndarray, most: int) -> Iterator[slice]:
    """Rows in runs of about ``most`` of ``size``, one row at least."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, upto)
        at = upto


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of non-empty lines, and the row of each."""
    joined = b"\n".join(lines)
    if joined.isascii():
        codes = np.frombuffer(joined, np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, lines), np.int64, len(lines))
    else:
        text = joined.decode()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, text.split("\n")), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    h = np.concatenate([codes, np.zeros(WIDTH, np.uint64)])
    for k, multiplier in zip((1, 2, 4), PLACE, strict=True):  # of one, two, four and then eight characters
        h = h[:-k] * multiplier + h[k:]
        h ^= h >> np.uint64(29)
    n = np.maximum(size - WIDTH + 1, 1)
    rows = np.repeat(np.arange(len(lines)), n)
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    found = mix(h[at])
    short = np.flatnonzero(size < WIDTH)
    if len(short):  # the whole line is the shingle
        first = (np.cumsum(n) - n)[short]
        found[first] = np.array([xxhash.xxh3_64_intdigest(lines[i]) for i in short], np.uint64)
    return found, rows


def signatures(lines: list[bytes]) -> np.ndarray:
    """Lines x bins of 16-bit symbols."""
    out = np.empty((len(lines), BINS), np.uint16)
    for part in portions(np.fromiter(map(len, lines), np.int64, len(lines)), PORTION):
        h, rows = shingle_hashes(lines[part])
        n, none = part.stop - part.start, np.uint64((1 << 64) - 1)
        slot = rows * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
        least = np.full(n * BINS, none)
        np.minimum.at(least, slot, h & np.uint64((1 << 40) - 1))
        least = least.reshape(-1, BINS)
        full = least != none
        # an empty bin takes the value of the next full one, told apart by how far it had to go
        place = np.where(full, np.arange(BINS), 3 * BINS)
        twice = np.concatenate([place, np.where(full, place + BINS, 3 * BINS)], axis=1)
        nearest = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        value = np.take_along_axis(least, nearest % BINS, axis=1)
        gone = (nearest - np.arange(BINS)).astype(np.uint64)
        out[part] = mix(value + gone * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def band_keys(symbols: np.ndarray) -> np.ndarray:
    """Lines x bands of 64-bit keys."""
    out = np.empty((len(symbols), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(symbols), b + 1, np.uint64)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, b * ROWS + k])
        out[:, b] = key.astype(np.int64)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return in_batches(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))


def _halves(prints: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def places(docs: DataFrame) -> DataFrame:
    """``hi, lo, doc_id, line`` of every line with a word; ``hi, lo``: its print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints: list[bytes] = []
            line: list[int] = []
            n = []
            for text in batch.column(1).to_pylist():
                before = len(line)
                for i, x in enumerate(normal_lines(text)):
                    if x:
                        prints.append(line_print(x))
                        line.append(i)
                n.append(len(line) - before)
            doc = np.repeat(batch.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([*_halves(prints), pa.array(doc), pa.array(line, pa.int32())], ["hi", "lo", "doc_id", "line"])

    found = _texts(docs).mapInArrow(tidy(run), "hi long, lo long, doc_id long, line int")
    return found.where(F.col("hi").isNotNull() & F.col("lo").isNotNull())  # as joins ask for: so all users share one exchange


def _distinct_lines(batch: pa.RecordBatch, seen: set[bytes], most: int = 1 << 16) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Prints and normalised lines of a batch, in portions; what the task has lately given isn't given again."""
    prints: list[bytes] = []
    lines: list[bytes] = []
    held = 0
    for text in batch.column(1).to_pylist():
        for x in normal_lines(text):
            if x:
                p = line_print(x)
                if p not in seen:
                    if len(seen) >= most:
                        seen.clear()
                    seen.add(p)
                    prints.append(p)
                    lines.append(x)
                    held += len(x)
        if held > 1 << 20:
            yield prints, lines
            prints, lines, held = [], [], 0
    if prints:
        yield prints, lines


def banded(docs: DataFrame) -> DataFrame:
    """``key, hi`` of every distinct line and band; ``hi``: the first half of its print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for prints, lines in _distinct_lines(batch, seen):
                keys = band_keys(signatures(lines))
                hi = np.repeat(np.frombuffer(b"".join(prints), np.int64)[::2], BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(hi)], ["key", "hi"])

    return _texts(docs).mapInArrow(tidy(run), "key long, hi long")


def contents(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``hi, lo, content`` of the lines with those ``hi``, once each."""
    sieve = sieve_of(prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for found, lines in _distinct_lines(batch, seen):
                at = sieve_places(np.frombuffer(b"".join(found), np.int64)[::2])
                want = np.flatnonzero(sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(want):
                    columns = [*_halves([found[i] for i in want]), pa.array([lines[i] for i in want], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["hi", "lo", "content"])

    found = _texts(docs).mapInArrow(tidy(run), "hi long, lo long, content binary")
    return found.join(prints, "hi", "left_semi").groupBy("hi", "lo").agg(F.first("content").alias("content"))


def shingle_set(line: bytes) -> set[str]:
    text = line.decode()
    return {text[i : i + WIDTH] for i in range(max(1, len(text) - WIDTH + 1))}


def similar(x: bytes, y: bytes, percent: int) -> bool:
    s, t = shingle_set(x), shingle_set(y)
    shared = len(s & t)
    return 100 * shared >= percent * (len(s) + len(t) - shared)


class Sets:
    """The shingle sets of lines as ``HASH``-bit hashes, sorted, one after the other."""

    def __init__(self, lines: list[bytes]) -> None:
        parts = []
        for part in portions(np.fromiter(map(len, lines), np.int64, len(lines)), 4 * PORTION):
            h, rows = shingle_hashes(lines[part])
            parts.append(sorted_distinct((rows + part.start).astype(np.uint64) << np.uint64(HASH) | h >> np.uint64(64 - HASH)))
        packed = np.concatenate(parts)
        self.hashes = packed & np.uint64((1 << HASH) - 1)
        self.size = np.bincount((packed >> np.uint64(HASH)).astype(np.int64), minlength=len(lines))
        self.start = np.cumsum(self.size) - self.size

    def at(self, rows: np.ndarray) -> np.ndarray:
        """Where the hashes of these rows are, one row after the other."""
        n = self.size[rows]
        return np.arange(n.sum()) + np.repeat(self.start[rows] - (np.cumsum(n) - n), n)

    def shared(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How many hashes the sets of each pair of rows have in common."""
        out = np.zeros(len(r), np.int64)
        for part in portions(self.size[r] + self.size[c], 1 << 18):
            rows = np.concatenate([r[part], c[part]])
            pair = np.tile(np.arange(part.stop - part.start, dtype=np.uint64), 2)
            both = np.sort(np.repeat(pair, self.size[rows]) << np.uint64(HASH) | self.hashes[self.at(rows)])
            same = both[1:][both[1:] == both[:-1]] >> np.uint64(HASH)
            out[part] = np.bincount(same.astype(np.int64), minlength=part.stop - part.start)
        return out

    def all_shared(self, rows: np.ndarray, columns: int = 4096) -> np.ndarray:
        """Rows x rows: how many hashes they have in common, from the incidence of those that two rows have or more."""
        at = self.at(rows)
        line = np.repeat(np.arange(len(rows)), self.size[rows])
        order = np.argsort(self.hashes[at], kind="stable")
        h, line = self.hashes[at][order], line[order]
        code = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
        twice = np.bincount(code)[code] > 1
        code, line = code[twice], line[twice]
        code = np.cumsum(np.diff(code, prepend=code[:1]) != 0)
        out = np.zeros((len(rows), len(rows)), np.float32)
        for first in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
            lo, hi = np.searchsorted(code, [first, first + columns])
            a = np.zeros((len(rows), min(columns, int(code[-1]) + 1 - first)), np.float32)
            a[line[lo:hi], code[lo:hi] - first] = 1
            out += a @ a.T
        return out


def group_links(groups: np.ndarray, line: np.ndarray, lines: list[bytes], percent: int) -> np.ndarray:
    """Pairs of ``lines`` that stand in one group and are similar, enough to give the components of all such pairs; ``groups`` is ascending, ``line`` the index of each row's line."""
    sets = Sets(lines)
    edges = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    count = np.diff(np.append(edges, len(groups)))
    r, c, shared = [], [], []

    def add(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        near = 100 * n >= percent * (sets.size[x] + sets.size[y] - n) - 200  # a few hashes may be equal by chance
        r.append(x[near])
        c.append(y[near])
        shared.append(n[near])

    few = count <= FEW
    if few.any():
        start, n = np.repeat(edges[few], count[few]), np.repeat(count[few], count[few])
        own = np.arange(len(start)) - np.repeat(np.cumsum(count[few]) - count[few], count[few])  # place in the group
        later = n - 1 - own
        x = np.repeat(start + own, later)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
        pairs = sorted_distinct(np.minimum(line[x], line[y]) * len(lines) + np.maximum(line[x], line[y]))
        x, y = pairs // len(lines), pairs % len(lines)
        able = 100 * np.minimum(sets.size[x], sets.size[y]) >= percent * np.maximum(sets.size[x], sets.size[y]) - 200
        x, y = x[able], y[able]
        add(x, y, sets.shared(x, y))
    for at, n in zip(edges[~few], count[~few], strict=True):
        rows = line[at : at + n]
        both = sets.all_shared(rows)
        x, y = np.nonzero(np.triu(100 * both >= percent * (sets.size[rows][:, None] + sets.size[rows] - both) - 200, 1))
        add(rows[x], rows[y], both[x, y].astype(np.int64))
    if not r:
        return np.empty((2, 0), np.int64)
    x, y, n = np.concatenate(r), np.concatenate(c), np.concatenate(shared)
    over = 100 * n - percent * (sets.size[x] + sets.size[y] - n)
    sure = np.stack([x, y])[:, over > 200]
    root = local_components(len(lines), sure)
    open_ = np.flatnonzero((over <= 200) & (root[x] != root[y]))  # what is united already needs no closer look
    good = [i for i in open_ if similar(lines[x[i]], lines[y[i]], percent)]
    return np.concatenate([sure, np.stack([x[good], y[good]])], axis=1)


def compared(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that unite the similar lines of each group, of ``g, part, nid, content``, whose groups are each together."""

    def links(table: pa.Table) -> pa.RecordBatch:
        g, part = table.column("g").to_numpy(), table.column("part").to_numpy()
        group = np.cumsum((np.diff(g, prepend=g[:1]) != 0) | (np.diff(part, prepend=part[:1]) != 0))
        nid, first, line = np.unique(table.column("nid").to_numpy(), return_index=True, return_inverse=True)
        lines = table.column("content").take(pa.array(first)).to_pylist()
        root = local_components(len(nid), group_links(group, line, lines, percent))
        moved = np.flatnonzero(root != np.arange(len(nid)))
        return pa.RecordBatch.from_arrays([pa.array(nid[moved]), pa.array(nid[root[moved]])], ["a", "b"])

    return in_batches(members.select("g", "part", "nid", "content")).mapInArrow(tidy(by_groups(links)), "a long, b long")


def grouped(members: DataFrame) -> DataFrame:
    """``g, part, nid`` of what is to be compared, from ``key, nid, size``: keys with the same members are one group, large keys pairs of blocks."""
    large = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_CHARACTERS))
    blocks = cut(members.groupBy("key").agg(large.alias("blocks")).where(F.col("blocks") > 1))
    light = members.join(blocks, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("nid")).alias("nids"))  # a block at most
    light = light.select("nids").distinct().select(F.xxhash64("nids").alias("g"), F.lit(0).cast("long").alias("part"), F.explode("nids").alias("nid"))
    heavy = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    heavy = heavy.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where(F.col("block") != F.col("other"))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return light.unionByName(heavy.select(F.col("key").alias("g"), pair.alias("part"), "nid"))


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``hi, lo, component`` of every line that is linked with another one."""
    # one exchange, used twice: to find the keys of two lines or more, and to give these to their members
    keys = banded(docs).repartition("key")
    several = keys.groupBy("key").agg(F.min("hi").alias("a"), F.max("hi").alias("b")).where(F.col("a") < F.col("b")).select("key")
    # few keys have two members: they are hashed, and the others need no sorting
    shared = cut(keys.join(several.hint("shuffle_hash"), "key").distinct())
    lines = contents(docs, shared.select("hi").distinct())
    lines = cut(lines.withColumn("nid", F.monotonically_increasing_id()).withColumn("size", F.length("content").cast("long")))
    # lines that share but half a print come along: all that is compared is compared by content
    members = cut(shared.join(lines.select("hi", "nid", "size"), "hi").select("key", "nid", "size"))
    ready = grouped(members).join(lines.select("nid", "content"), "nid").repartition("g", "part").sortWithinPartitions("g", "part")
    parts = components(compared(ready, percent))
    return lines.join(parts.withColumnRenamed("node", "nid"), "nid").select("hi", "lo", "component")


def kept_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, lines array<int>``: places of the lines with a word that stay."""
    first = places(docs).groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "line")).alias("at"))
    placed = first.join(cut(linked(docs, percent)), ["hi", "lo"], "left")
    alone = placed.where(F.col("component").isNull()).select("at")
    rooted = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("at").alias("at")).select("at")
    return alone.unionByName(rooted).groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list("at.line").alias("lines"))


def without(text: str | None, stays: np.ndarray | None) -> tuple[str | None, int, int]:
    """The text with those of its lines with a word that stay (None: all), and how many it had and has."""
    if text is None:
        return None, 0, 0
    split = text.split("\n")
    worded = [bool(x.strip(SPACE)) for x in split]
    n = sum(worded)
    if stays is None:
        return text, n, n
    some = set(stays)
    left = [x for i, x in enumerate(split) if not worded[i] or i in some]
    kept = n - (len(split) - len(left))
    return (text if kept == n else "\n".join(left)), n, kept


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_kept", T.LongType())]))
def _rebuilt(doc_id: pa.Array, text: pa.Array, lines: pa.Array) -> pa.Array:
    texts, n, kept = [], [], []
    for d, x, stays in zip(doc_id.is_valid().to_pylist(), text.to_pylist(), lines.to_pylist(), strict=True):
        y, a, b = without(x, (stays or []) if d else None)
        texts.append(y)
        n.append(a)
        kept.append(b)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], ["text", "n_lines", "n_kept"])


def dedup_lines(docs: DataFrame, percent: int = PERCENT, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; other columns stay. Adds ``n_lines`` and ``n_kept`` (lines with a word;
    with underscores appended if ``docs`` has such columns). ``drop_emptied``: without the documents that lost all their lines."""
    columns = docs.columns
    row = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    stay = kept_lines(docs, percent).select(F.col("doc_id").alias("id"), "lines")
    done = in_batches(row.join(stay, "id", "left")).select("row", _rebuilt("id", "row.text", "lines").alias("new"))
    if drop_emptied:
        done = done.where((F.col("new.n_kept") > 0) | (F.col("new.n_lines") == 0))
    rest = [F.col("new.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]
    return done.select(*rest, F.col("new.n_lines").alias(fresh("n_lines", columns)), F.col("new.n_kept").alias(fresh("n_kept", columns)))
