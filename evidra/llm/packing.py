"""Best-fit packing (operator 10) by linear grouping.

Pieces of one length are alike, so the packing is worked out on the histogram of lengths: at most
``capacity`` numbers, whatever the corpus. Large lengths are sorted, cut into groups of equally many
pieces and rounded up to each group's longest. A linear programme over configurations of those few sizes,
by column generation, says how many sequences of each configuration to use. Actual lengths then take the
places of the rounded ones, the last of them fitted to the room that is really left; what is left over and
all small lengths go best-fit into the free room, and the documents of each length are dealt to the places
of that length by their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidra.llm.bpe import TOKEN_SLICE, encoder
from evidra.llm.common import batch, written
from evidra.llm.textcols import slices

CAPACITY = 2048
LARGE = 1 / 8
GROUPS = 64
_EPS = 1e-9

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The sizes, each any number of times, of largest total value within ``capacity``."""
    most = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    choices = []
    for _ in range(most):
        offered = np.full((len(sizes), capacity + 1), -1.0)
        for i, s in enumerate(sizes.tolist()):
            offered[i, s:] = best[: capacity + 1 - s] + value[i]
        pick = offered.argmax(0)
        got = offered[pick, np.arange(capacity + 1)]
        better = got > best + _EPS
        choices.append(np.where(better, pick, -1))
        best = np.where(better, got, best)
    used = np.zeros(len(sizes), np.int64)
    room = capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            used[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(used @ value), used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, rounded down: the relaxed programme's basic solution.

    Columns come in until the best one's gain proves that less than half a sequence could still be saved.
    """
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    wanted = demand * (1 + 1e-9 * np.arange(1, len(demand) + 1))  # no two ratios tie, so no round repeats
    for number in count():
        amount = inverse @ wanted
        gain, used = best_configuration(sizes, inverse.sum(0), capacity)
        if gain <= 1 + 1e-7 or amount.sum() * (1 - 1 / gain) < 0.5:
            break
        change = inverse @ used
        ratio = np.where(change > _EPS, amount / np.where(change > _EPS, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = used
        if number % 50 == 49:
            inverse = np.linalg.inv(basis)
            continue
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
    amount = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].round().astype(np.int64), int(a + 1e-6)) for j, a in enumerate(amount) if a >= 1 - 1e-6]


class Bins:
    """Equal bins held together: how many, and their runs of (length, copies in each)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]

    def add(self, count: int, runs: tuple) -> None:
        if count > 0:
            self.by_room[self.capacity - sum(n * k for n, k in runs)].append((count, runs))

    def best_fit(self, length: int, pieces: int) -> None:
        """Put ``pieces`` of one length where least room is left over; open bins for the rest."""
        room = length
        while pieces and room <= self.capacity:
            if not self.by_room[room]:
                room += 1
                continue
            count, runs = self.by_room[room].pop()
            each = min(room // length, pieces)
            bins = min(count, pieces // each)
            self.add(count - bins, runs)
            self.add(bins, runs + ((length, each),))
            pieces -= bins * each
        each = self.capacity // length
        self.add(pieces // each, ((length, each),))
        if pieces % each:
            self.add(1, ((length, pieces % each),))


def grouped(left: Mapping[int, int], lengths: list[int], groups: int) -> list[list[int]]:
    """``lengths``, longest first, in about ``groups`` runs of equally many pieces.

    With few lengths, and for lengths that are common enough, a run is a single length.
    """
    if len(lengths) <= groups:
        return [[n] for n in lengths]
    per, held = sum(left[n] for n in lengths) / groups, 0.0
    runs: list[list[int]] = [[]]
    for n in lengths:
        if runs[-1] and held + left[n] / 2 > per:
            runs.append([])
            held = 0.0
        runs[-1].append(n)
        held += left[n]
    return runs


def pack(histogram: Mapping[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, tuple]]:
    """Bins for pieces of the given lengths: (number of equal bins, their (length, copies) runs)."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    bins = Bins(capacity)
    bins.add(left.pop(capacity, 0), ((capacity, 1),))
    while True:  # what a programme's rounding down leaves is a smaller programme
        lengths = [n for n in left if left[n] and n > large * capacity]
        if not lengths:
            break
        runs = grouped(left, lengths, groups)
        sizes = np.array([run[0] for run in runs])
        demand = np.array([sum(left[n] for n in run) for run in runs])
        before = demand.sum()
        plans = [([i for i, k in enumerate(used.tolist()) for _ in range(k)], times) for used, times in configurations(sizes, demand, capacity)]
        for where, times in sorted(plans, key=lambda x: x[0]):  # configurations of the longest first
            while times:
                taken = _actual(left, runs, where, capacity)
                if taken is None:
                    break
                step = min(times, *(left[n] // k for n, k in taken))
                for n, k in taken:
                    left[n] -= k * step
                bins.add(step, tuple(taken))
                times -= step
        if sum(left[n] for n in lengths) > before / 2:
            break
    for n in sorted(left, reverse=True):
        if left[n]:
            bins.best_fit(n, left[n])
    return [b for room in bins.by_room for b in room]


def _actual(left: dict[int, int], runs: list[list[int]], where: list[int], capacity: int) -> list[tuple[int, int]] | None:
    """Actual lengths for a configuration's places, as (length, copies); None if a group has run out.

    A place takes its group's longest piece, the last place the longest piece of any group that fits
    the room which is really left: so what rounding up wasted is given back.
    """
    taken: dict[int, int] = {}

    def longest(lengths, room: int) -> int | None:
        return next((n for n in lengths if n <= room and left[n] > taken.get(n, 0)), None)

    room = capacity
    for at, i in enumerate(where):
        run = runs[i] if at + 1 < len(where) else (n for j in range(len(runs)) for n in runs[j] if n <= room)
        n = longest(run, room)
        if n is None:
            return None
        taken[n] = taken.get(n, 0) + 1
        room -= n
    return list(taken.items())


def places(bins: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """The packing as ranges of ranks within a length, sorted by (length, rank).

    The pieces of a length with ranks from ``rank`` on, ``copies`` to a bin, go to the bins from ``bin``
    on, at ``offset`` and every ``length`` after it.
    """
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for count, runs in bins:
        offset = 0
        for n, k in runs:
            rank = ranks.get(n, 0)
            rows.append((n, rank, first, offset, k))
            ranks[n] = rank + k * count
            offset += n * k
        first += count
    rows.sort()
    columns = zip(*rows) if rows else [()] * 5
    return {name: np.array(x, np.int64) for name, x in zip(("length", "rank", "bin", "offset", "copies"), columns)}


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and ``end_id``.

    Only documents of over ``capacity`` ids are cut; their first piece takes the remainder.
    """

    def cut(batches):
        enc = encoder(tokenizer)
        for rows in batches:
            for part in slices(rows, "text", TOKEN_SLICE):
                flat, n = enc.encode_column(part.column("text"))
                ids = np.insert(flat, np.cumsum(n), end_id).astype("<u4")
                total = n + 1
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (total - (pieces - 1) * capacity)[doc]
                start = np.where(number == 0, 0, first + (number - 1) * capacity)
                length = np.where(number == 0, first, capacity)
                at = np.repeat(np.cumsum(total) - total, pieces) + start
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
                yield batch(PIECES, part.column("doc_id").take(pa.array(doc)), number, start, length, crc)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, per_salt: int = 500_000) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Null texts are empty: their only id is ``end_id``. Repeated rows and null ids are pieces of their own;
    an empty table gives no rows; only doc_id and text are read. Only the histogram of lengths reaches
    the driver. Pieces are ranked within a length in salts of about ``per_salt``, so a length that a third
    of all pieces share is dealt over tasks.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity))
    salts = max(1, pieces.count() // per_salt)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).alias("_salt")
    salted = pieces.select("*", salt)
    counts = written(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    plan = places(pack(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.select("*", (F.row_number().over(order) - 1).alias("_rank")).join(base, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))
    step = max(plan["rank"].max(initial=0), max(histogram.values(), default=0)) + 1
    held = spark.sparkContext.broadcast((plan, plan["length"] * step + plan["rank"], step))  # rows follow capacity, not the corpus

    def place(batches):
        plan, keys, step = held.value
        for rows in batches:
            if rows.num_rows:
                length, rank = (rows.column(c).to_numpy() for c in ("length", "_rank"))
                at = np.searchsorted(keys, length * step + rank, "right") - 1
                within, copies = rank - plan["rank"][at], plan["copies"][at]
                own = [rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                yield batch(PLACED, *own, plan["bin"][at] + within // copies, plan["offset"][at] + within % copies * length)

    return ranked.mapInArrow(place, PLACED)
