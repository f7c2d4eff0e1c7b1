"""Best-fit packing by bin completion with branch and bound.

Documents become pieces of at most ``capacity`` tokens; only the number of pieces of each length (at most
``capacity`` numbers, however large the corpus) goes to the driver. There, bins are completed around the largest
piece left: the fillings of its rest that no other filling dominates are tried, each for as many bins as the counts allow and
then for a single one. A filling is dominated if a piece that it leaves out could stand for some of its pieces that are together no
longer, within the room that it wastes. The best-fit solution is the first incumbent; a branch is left as soon as its waste proves
that it can't beat the incumbent, and the search ends when no solution can use fewer bins (a lower bound is met or all branches are
done), which ``Packing.proved`` says, or after ``NODES`` completions: packing is NP-hard, so some bound on the work is needed; what
was found till then is never worse than best fit. The result is a list of patterns, so pieces are placed by their rank among the
pieces of their length, which is counted in two levels: no task holds all pieces of a length.

Defined results: a null text counts as empty; an empty text is one piece that holds the separator alone; long texts are cut and
packed whole; repeated rows are packed each; pieces that tie in length, id, piece and start take their places in any order; an empty
table gives no rows; null ids are kept and packed. Other columns of documents are not read; ``pack`` keeps those of its pieces, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import tokens
from quarry.llm.batches import fresh, in_batches, tidy
from quarry.session import cut

CAPACITY = 2048
#: Completions that the search makes, and steps that it takes to find them.
NODES, STEPS = 10_000, 1_000_000
#: Pieces of one length that are ranked in one task.
CELL = 200_000


class Pattern(NamedTuple):
    filling: tuple[tuple[int, int], ...]  # (length, how many), longest first
    bins: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest pieces first, on counts: bins with the same filling are handled together."""
    open_bins: dict[int, list[list]] = {}  # room left -> [filling, number of bins]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, groups in open_bins.items() if r >= length and groups), default=None)
            if room is None:
                each = capacity // length
                bins, rest = divmod(left, each)
                for n, k in ((bins, each), (1, rest)):
                    if n and k:
                        open_bins.setdefault(capacity - k * length, []).append([((length, k),), n])
                break
            filling, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            each = min(room // length, left)
            used = min(n, left // each)
            if used < n:
                open_bins.setdefault(room, []).append([filling, n - used])
            open_bins.setdefault(room - each * length, []).append([(*filling, (length, each)), used])
            left -= used * each
    return [Pattern(tuple(f), n) for groups in open_bins.values() for f, n in groups]


class Packing(NamedTuple):
    patterns: list[Pattern]
    bins: int
    bound: int
    proved: bool  # no packing uses fewer bins


def sums_of(filling: Iterable[tuple[int, int]]) -> int:
    """The sums of all subsets of a filling, as bits of a number."""
    sums = 1
    for length, n in filling:
        step = 1
        while n:  # 1, 2, 4, ... and what is left make every number up to n
            take = min(step, n)
            sums |= sums << length * take
            n -= take
            step *= 2
    return sums


def dominated(filling: tuple[tuple[int, int], ...], waste: int, left: dict[int, int], out: int) -> bool:
    """Whether a piece that is left out could stand for pieces of the filling that are no longer together, within its waste.

    ``left``: counts, those of the filling included; ``out``: lengths that are left, as bits.
    """
    for length, n in filling:
        if left[length] == n:
            out &= ~(1 << length)
    reach, spread = sums_of(filling), 1
    while spread <= waste:  # sums of up to ``waste`` less
        reach |= reach << min(spread, waste + 1 - spread)
        spread *= 2
    found = reach & out
    for length, n in filling:
        if found >> length & 1:  # there by itself, at least: what do the shorter ones make?
            shorter = sums_of(x for x in filling if x[0] < length)
            if not shorter >> max(0, length - waste) & ((1 << min(waste, length) + 1) - 1):
                found &= ~(1 << length)
    return bool(found)


def completions(left: dict[int, int], room: int, most_waste: int, steps: list[int]) -> Iterator[tuple[tuple[int, int], ...]]:
    """The undominated fillings of ``room`` that waste ``most_waste`` at most, longest pieces and most of them first.

    Every number of pieces of a length is tried, from as many as fit down to none. ``steps`` holds how many may still be taken.
    """
    lengths = [n for n in sorted(left, reverse=True) if n <= room and left[n]]
    out = sum(1 << n for n in lengths)
    if not lengths:
        if room <= most_waste:
            yield ()
        return
    # a step: (first length that may come next, room, filling); the last is taken first
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(0, room, ())]
    while stack and steps[0] > 0:
        steps[0] -= 1
        at, rest, filling = stack.pop()
        while at < len(lengths) and lengths[at] > rest:
            at += 1
        if at == len(lengths):
            if rest <= most_waste and not dominated(filling, rest, left, out):
                yield filling
            continue
        length = lengths[at]
        for n in range(min(rest // length, left[length]) + 1):
            stack.append((at + 1, rest - n * length, (*filling, (length, n)) if n else filling))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each bound on short pieces, those over half a bin need one each, and what the short ones
    do not find room for beside them."""
    best = 0
    total = sum(n * c for n, c in counts.items())
    for least in [1, *(n for n in counts if 2 * n <= capacity)]:
        alone = sum(c for n, c in counts.items() if n > capacity - least)
        half = [(n, c) for n, c in counts.items() if capacity < 2 * n and n <= capacity - least]
        bins = sum(c for _, c in half)
        rest = sum(n * c for n, c in counts.items() if least <= n and 2 * n <= capacity) - sum((capacity - n) * c for n, c in half)
        best = max(best, alone + bins + max(0, -(-rest // capacity)))
    return max(best, -(-total // capacity))


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Patterns that pack ``counts`` (length -> pieces) into as few bins as the search finds."""
    left = {n: c for n, c in counts.items() if c}
    if not left:
        return Packing([], 0, 0, True)
    if min(left) < 1 or max(left) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    best = best_fit(left, capacity)
    fewest, floor = sum(p.bins for p in best), lower_bound(left, capacity)
    total = sum(n * c for n, c in left.items())
    steps, nodes, waste = [STEPS], 0, 0
    made: list[Pattern] = []

    def branches() -> Iterator[tuple[Pattern, int]]:
        """What the next bins may be: patterns around the largest piece, and what they waste."""
        top = max(left)
        left[top] -= 1
        allowed = (fewest - 1) * capacity - total - waste  # one bin fewer has no room for more
        for filling in completions(left, capacity - top, allowed, steps):
            whole = dict(filling)
            whole[top] = whole.get(top, 0) + 1
            lost = capacity - sum(n * c for n, c in whole.items())
            left[top] += 1
            bins = min(left[n] // c for n, c in whole.items())
            for b in (bins, 1)[: 2 if bins > 1 else 1]:
                yield Pattern(tuple(sorted(whole.items(), reverse=True)), b), lost * b
            left[top] -= 1
        left[top] += 1

    def take(pattern: Pattern, sign: int) -> None:
        for n, c in pattern.filling:
            now = left.get(n, 0) - sign * c * pattern.bins
            if now:
                left[n] = now
            else:
                left.pop(n, None)

    open_ = [branches()]
    while open_ and fewest > floor and nodes < NODES and steps[0] > 0:
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            if made:
                last = made.pop()
                take(last, -1)
                waste -= last.bins * (capacity - sum(n * c for n, c in last.filling))
            continue
        pattern, lost = step
        if waste + lost > (fewest - 1) * capacity - total:
            continue
        nodes += 1
        take(pattern, 1)
        made.append(pattern)
        waste += lost
        if left:
            open_.append(branches())
            continue
        bins = sum(p.bins for p in made)
        if bins < fewest:
            best, fewest = list(made), bins
        take(made.pop(), -1)
        waste -= lost
    return Packing(best, fewest, floor, fewest == floor or not open_)


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the separator, cut only where too long."""
    end = int(separator).to_bytes(4, "little")

    def project(doc_ids: pa.Array, ids: Iterator[bytes]) -> pa.RecordBatch:
        rows, piece, start, length, crc = [], [], [], [], []
        step = capacity * 4
        for at, data in enumerate(ids):
            data += end
            for k, i in enumerate(range(0, len(data), step)):
                part = data[i : i + step]
                rows.append(at)
                piece.append(k)
                start.append(i // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        columns = [doc_ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(path)
        for batch in batches:
            yield project(batch.column(0), map(encoder.encode, batch.column(1).to_pylist()))

    return in_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Places(NamedTuple):
    """For one length, by ascending first rank: which pattern serves the ranks from there."""

    first: np.ndarray
    sequence: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray


def places(patterns: list[Pattern]) -> dict[int, Places]:
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for filling, bins in patterns:
        offset = 0
        for length, each in filling:
            rows.setdefault(length, []).append((taken.get(length, 0), sequence, each, offset))
            taken[length] = taken.get(length, 0) + each * bins
            offset += each * length
        sequence += bins
    return {n: Places(*(np.array(x, "i8") for x in zip(*r, strict=True))) for n, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (with underscores appended if there are such columns) to ``pieces``, which have a ``length``."""
    names = pieces.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = cut(pieces.select(row, F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("id")))
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = places(bin_completion(counts, capacity).patterns)
    many = [(n, -(-c // CELL)) for n, c in sorted(counts.items()) if c > CELL]  # at most ``capacity`` rows, so they go everywhere
    celled = rows.withColumn("cell", F.lit(0).cast("long"))
    if many:
        cells = F.broadcast(pieces.sparkSession.createDataFrame(many, "length long, cells long"))
        key = F.pmod(F.xxhash64("id"), F.col("cells"))
        celled = rows.join(cells, "length", "left").withColumn("cell", F.coalesce(key, F.lit(0).cast("long"))).drop("cells")
    order = Window.partitionBy("length", "cell").orderBy("id")
    ranked = celled.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    if many:
        before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sizes = celled.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
        starts = sizes.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        ranked = ranked.join(starts, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
    added = [fresh("sequence_id", names), fresh("offset", names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                p = where[int(n)]
                k = np.searchsorted(p.first, rank[rows], "right") - 1
                bins, slot = np.divmod(rank[rows] - p.first[k], p.per_bin[k])
                sequence[rows] = p.sequence[k] + bins
                offset[rows] = p.offset[k] + slot * n
            yield pa.RecordBatch.from_arrays([*batch.column("row").flatten(), pa.array(sequence), pa.array(offset)], [*names, *added])

    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    return in_batches(ranked.select("row", "length", "rank")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_documents(docs, path, capacity), capacity)
