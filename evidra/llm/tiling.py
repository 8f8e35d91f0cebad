"""Benchmark decontamination by greedy string tiling (operator 9).

Texts and test items are sequences of lower-cased words. A document meets an item where they share a run
of ``SEED`` words. The pair is then tiled: the longest runs of words that are free in both are marked
first, found by running Karp-Rabin hashes of ever shorter windows, down to ``SEED`` words. Tiles may come
in any order, so a passage whose sentences were moved is caught all the same. A document is contaminated
by an item of which tiles cover at least ``COVERAGE``.

The items are a given query set. They go to the tasks in blocks of at most ``BLOCK_WORDS`` words, each of
which is a pass over all documents; a document is never compared with an item it shares no seed with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidra.llm.common import batch, mixed
from evidra.llm.textcols import VALUES_LOWER, shingles_of, slices, texts_of, words_of

SEED = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
FOUND = "doc_id long, item_id long, coverage double, tiles int, longest int, item_words int"
#: Every ASCII sign that is no letter or digit parts words.
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(column: pa.Array):
    return words_of(texts_of(column), VALUES_LOWER, _PARTS)


def _windows(values: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and running hashes of all windows of ``size`` free words."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        step, reach, at = values.copy(), 1, 0
        # Windows of 1, 2, 4, ... words; those of the wanted size are put together from its binary digits.
        left, power = size, _ODD
        while left:
            if left & 1:
                hashes = hashes * power + step[at : at + n]
                at += reach
            left >>= 1
            if left:
                step = step[:-reach] * power + step[reach:]
                power = power * power
                reach *= 2
    taken = np.concatenate([[0], np.cumsum(~free)])
    start = np.flatnonzero(taken[size:] == taken[:-size])
    return start, hashes[start]


def greedy_tiles(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (text start, item start, words), longest first; no word lies in two of them."""
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)))
    while True:
        i, hi = _windows(item, free_item, size)
        j, hj = _windows(text, free_text, size)
        found = []
        order = np.argsort(hi, kind="stable")
        lo, up = (np.searchsorted(hi[order], hj, s) for s in ("left", "right"))
        for k in np.flatnonzero(up > lo):
            b = int(j[k])
            for a in i[order[lo[k] : up[k]]].tolist():
                if a and b and free_item[a - 1] and free_text[b - 1] and item[a - 1] == text[b - 1]:
                    continue  # part of the match that begins one word earlier
                n = 0
                while a + n < len(item) and b + n < len(text) and free_item[a + n] and free_text[b + n] and item[a + n] == text[b + n]:
                    n += 1
                if n >= size:
                    found.append((-n, a, b))
        marked = False
        for n, a, b in sorted(found):
            n = -n
            if free_item[a : a + n].all() and free_text[b : b + n].all():
                free_item[a : a + n] = free_text[b : b + n] = False
                tiles.append((b, a, n))
                marked = True
        if found and marked:
            continue  # what a longer tile has cut off may still hold windows of this size
        if size == least:
            return tiles
        size = max(least, size // 2)


class Items:
    """A block of test items as word hashes, with the items of every seed."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        seeds = [_seeds(w) for w in words]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]

    def found(self, column: pa.Array, coverage: float):
        """(row, item, coverage, tiles, longest, item words) of the column's texts."""
        words = _words(column)
        if not len(self.seeds) or not len(words.hashed):
            return
        flat, sizes = shingles_of(words, SEED)
        at = np.minimum(np.searchsorted(self.seeds, flat), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == flat)
        ends = np.cumsum(sizes)
        row = np.searchsorted(ends, hit, "right")
        begin = np.cumsum(words.count) - words.count
        for r in np.unique(row).tolist():
            mine = hit[row == r]
            text = words.hashed[begin[r] : begin[r] + words.count[r]]
            place = mine - (ends[r] - sizes[r])
            lo, up = (np.searchsorted(self.seeds, flat[mine], s) for s in ("left", "right"))
            owners: dict[int, list[int]] = {}
            for p, a, b in zip(place.tolist(), lo.tolist(), up.tolist()):
                for o in set(self.owner[a:b].tolist()):
                    owners.setdefault(o, []).append(p)
            for o, places in owners.items():
                item = self.words[o]
                near = np.zeros(len(text) + 1, np.int64)  # only words near a seed can lie in a tile
                np.add.at(near, np.maximum(np.array(places) - len(item), 0), 1)
                np.add.at(near, np.minimum(np.array(places) + len(item), len(text)), -1)
                inside = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                gap = np.flatnonzero(np.diff(inside) > 1) + 1
                part = np.insert(text[inside], gap, np.uint64(0))  # no word has hash 0 in an item
                tiles = greedy_tiles(part, item)
                share = sum(n for _, _, n in tiles) / len(item)
                if share >= coverage:
                    yield r, self.ids[o], share, len(tiles), max(n for _, _, n in tiles), len(item)


def _seeds(words: np.ndarray) -> np.ndarray:
    """The same hashes of ``SEED`` words as :func:`shingles_of` gives inside a text."""
    if len(words) < SEED:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - SEED + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SEED):
            out = out * _ODD + mixed(words[i : len(words) - SEED + 1 + i] + np.uint64(i + 1))
        return mixed(out + np.uint64(SEED))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The test items in blocks of about ``block_words`` words; each block is one bounded collect."""
    sized = benchmark.select("item_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"))
    blocks = int((sized.agg(F.sum("n")).first()[0] or 0) // block_words) + 1
    for k in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        if rows:
            words = _words(pa.array([r.text for r in rows], pa.string()))
            yield Items([r.item_id for r in rows], np.split(words.hashed, np.cumsum(words.count)[:-1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest, item_words) of every document and item that it leaks.

    Null and empty texts leak nothing; items of fewer than ``SEED`` words have no seed and are never
    found. Repeated documents and items are reported each; null ids stay null. Empty tables give no
    rows. Of the tables only doc_id, text and item_id, text are read.
    """
    spark = docs.sparkSession
    out = None
    for items in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(items)

        def find(batches, held=held):
            for rows in batches:
                for part in slices(rows, "text"):
                    got = list(held.value.found(part.column("text"), coverage))
                    if got:
                        row, *rest = zip(*got)
                        yield batch(FOUND, part.column("doc_id").take(pa.array(row)), *map(list, rest))

        found = docs.select("doc_id", "text").mapInArrow(find, FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns; see :func:`contaminated`."""
    for items in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches, held=held):
            for rows in batches:
                for part in slices(rows, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, *_ in held.value.found(part.column("text"), coverage)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
