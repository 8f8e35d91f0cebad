"""The first epoch of ``linkpred.train_margin``, whose vectors follow from ids, and the loss of the second.

Ids are dealt to blocks. An edge reaches its head's block, and those of its tail and wrong tail, as ids and not as
vectors; a block makes its vectors from what it got. For the second loss, h + r travels once to the tail and once to the
wrong tail. Rows between the steps are columns of one kind for one block, packed. Ends of very many edges are in
no block's hands: their sums are taken where their edges are.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Task-side helpers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ids of a block and edges of a batch at most, at up to eight numbers a vector; fewer for longer vectors.
BLOCK_IDS = 65_536
BATCH_EDGES = 131_072
#: Texts that are hashed at once.
TEXTS = 65_536
SUMS = "kind int, id long, g array<double>, n long, loss double"
PACKED = "block int, kind int, data binary"
#: What a block gets: nothing, its heads' edges, pulls on its ids, h + r at a tail, h + r at a wrong tail, a loss.
NONE, EDGES, PULLS, TAILS, WRONG, LOSS = range(-1, 5)

_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def md5_digits(texts: pa.Array) -> np.ndarray:
    """The first 32 bits of each text's md5 as a whole number; texts of one md5 block go through together."""
    out = np.empty(len(texts), np.int64)
    for at in range(0, len(texts), TEXTS):
        part = texts.slice(at, TEXTS)
        sizes = pc.binary_length(part).to_numpy()
        if sizes.max() > 55:
            out[at : at + len(part)] = [int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") for x in part.to_pylist()]
        else:
            out[at : at + len(part)] = _hashed(_padded(part, sizes), sizes)
    return out


def _padded(texts: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """One row of bytes for each text of 55 or fewer, and the bit that md5 puts behind."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    width = 4 * (int(sizes.max()) // 4 + 1)
    rows = np.zeros((len(texts), width), np.uint8)
    rows[np.arange(width) < sizes[:, None]] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    rows[np.arange(len(texts)), sizes] = 0x80
    return rows


def _hashed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    words = dict(enumerate(rows.view("<u4").T.copy())) | {14: (sizes * 8).astype(np.uint32)}
    return _first_word(words, len(rows)).byteswap()


def _first_word(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first word of the md5 of n times 16 little-endian words, those left out being zero."""
    a, b, c, d = (np.full(n, x) for x in _START)
    for i in range(64):
        if i < 16:
            mixed, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, k = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += _SINES[i]
        if k in words:
            mixed += words[k]
        left = _TURNS[i // 16][i % 4]
        low = mixed >> np.uint32(32 - left)
        mixed <<= np.uint32(left)
        mixed |= low
        mixed += b
        a, b, c, d = d, mixed, b, c
    return a + _START[0]


def _text(ids: np.ndarray) -> pa.Array:
    return pc.cast(pa.array(ids, pa.int64()), pa.string())


def digit_matrix(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The vectors of ``linkpred.digit_vectors``; an id's texts differ in the position's digits only."""
    out = np.empty((len(ids), dim))
    for at in range(0, len(ids), TEXTS):
        text = _text(ids[at : at + TEXTS])
        each = np.arange(len(text))
        for k in range(dim):
            digits = str(k)
            if k == 0 or len(digits) > len(str(k - 1)):
                texts = pc.binary_join_element_wise(str(seed), text, digits, ":")
                sizes = pc.binary_length(texts).to_numpy()
                rows = _padded(texts, sizes)
            for place, digit in enumerate(digits, -len(digits)):
                rows[each, sizes + place] = ord(digit)
            out[at : at + len(text), k] = _hashed(rows, sizes) / 2.0**31 - 1
    return out


def wrong_tails(h: np.ndarray, r: np.ndarray, t: np.ndarray, entities: int, epoch: int) -> np.ndarray:
    """The wrong tails of ``linkpred.corrupted``."""
    drawn = md5_digits(pc.binary_join_element_wise(_text(h), _text(r), _text(t), str(epoch), ":"))
    return (t + 1 + drawn % (entities - 1)) % entities


def _unit(vecs: np.ndarray) -> np.ndarray:
    length = np.sqrt((vecs * vecs).sum(1))
    return vecs / np.where(length > 0, length, 1.0)[:, None]


def _square(vecs: np.ndarray) -> np.ndarray:
    return (vecs * vecs).sum(1)


def _add(g: np.ndarray, n: np.ndarray, at: np.ndarray, more: np.ndarray, weight: np.ndarray) -> None:
    """Sums of ``more`` and ``weight`` by position."""
    if len(at):
        for k in range(g.shape[1]):
            g[:, k] += np.bincount(at, more[:, k], len(g))
        n += np.bincount(at, weight, len(n)).astype(np.int64)


def _gathered(batches, rows: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


class FirstEpoch:
    """``hot`` ids and ``relations`` are few; everything else is dealt to ``blocks``."""

    def __init__(self, entities: int, dim: int, rate: float, margin: float, seed: int, hot: list[int], relations: list[int], slots: int):
        self.entities, self.dim, self.rate, self.margin, self.seed = entities, dim, rate, margin, seed
        room = max(1, min(BLOCK_IDS, BLOCK_IDS * 8 // dim))
        self.blocks = max(-(-entities // room), min(entities, 4 * slots))
        self.batch = max(1, min(BATCH_EDGES, BATCH_EDGES * 8 // dim))
        self.hot, self.relations = np.array(sorted(hot), np.int64), np.array(sorted(relations), np.int64)
        self.first_r = digit_matrix(self.relations, dim, seed + 1)
        ids, vec = np.dtype("<u4" if entities <= 2**32 else "<i8"), np.dtype(("<f8", (dim,)))
        u2, u4, i4, f8, i8 = (np.dtype(x) for x in ("<u2", "<u4", "<i4", "<f8", "<i8"))
        self.columns = {EDGES: (u2, u2, ids, u4), PULLS: (u2, ids, u2, i4), TAILS: (u2, ids, u4, vec), WRONG: (u2, u4, f8, vec), LOSS: (u2, f8, i8)}

    def know(self, hot_sums: list, relations: list) -> None:
        """Vectors after the first epoch of the hot ids, from (id, g, n), and of the relations, from (id, vec)."""
        g, n = np.zeros((len(self.hot), self.dim)), np.zeros(len(self.hot), np.int64)
        for row in hot_sums:
            at = np.searchsorted(self.hot, row["id"])
            g[at], n[at] = row["g"], row["n"]
        self.hot_v = self._step(self._first(self.hot), g, n)
        self.next_r = np.array([row["vec"] for row in sorted(relations, key=lambda row: row["id"])]).reshape(-1, self.dim)

    def steps(self, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, vec) after the first epoch, and the (loss, n) of the second by block."""
        block = F.col("id").cast("int").alias("block")
        every = edges.sparkSession.range(self.blocks).select(block, F.lit(NONE).alias("kind"), F.lit(b"").alias("data"))
        got = edges.mapInArrow(self.send, PACKED).unionByName(every).groupBy("block")
        asked = got.applyInArrow(lambda key, got: self.heads(key[0].as_py(), got), PACKED)
        if len(self.hot):
            asked = asked.unionByName(edges.mapInArrow(self.hot_heads, PACKED))
        tails = got.cogroup(asked.groupBy("block")).applyInArrow(
            lambda key, got, asked: self.tails(key[0].as_py(), got, asked), PACKED)
        losses = got.cogroup(tails.groupBy("block")).applyInArrow(
            lambda key, got, asked: self.wrong(key[0].as_py(), got, asked), "loss double, n long")
        return got.applyInArrow(lambda key, got: self.vectors(key[0].as_py(), got), "id long, vec array<double>"), losses

    # In tasks.

    def _first(self, ids: np.ndarray) -> np.ndarray:
        return _unit(digit_matrix(ids, self.dim, self.seed))

    def _step(self, vecs: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _unit(vecs - self.rate * g / np.maximum(n, 1)[:, None])

    def _edges(self, batches) -> Iterator[tuple[np.ndarray, ...]]:
        """Heads, positions of relations, tails and weights of a batch's different edges."""
        for table in _gathered(batches, self.batch):
            h, r, t = (table[c].to_numpy() for c in "hrt")
            r = np.searchsorted(self.relations, r)
            order = np.lexsort((t, r, h))
            h, r, t = h[order], r[order], t[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (t[1:] != t[:-1])]))
            yield h[new], r[new], t[new], np.diff(new, append=len(h))

    def _firsts(self, ids: np.ndarray) -> np.ndarray:
        """First vectors of ids that may occur several times."""
        ids, at = np.unique(ids, return_inverse=True)
        return self._first(ids)[at]

    def _ends(self, h: np.ndarray, r: np.ndarray, t: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, ...]:
        """Wrong tails, h + r - t, h + r - c and losses of the first epoch."""
        c = wrong_tails(h, self.relations[r], t, self.entities, 1)
        sums, ends = heads + self.first_r[r], self._firsts(np.concatenate([t, c]))
        e, f = sums - ends[: len(h)], sums - ends[len(h) :]
        return c, e, f, np.maximum(0.0, self.margin + _square(e) - _square(f))

    def _hot_at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the hot ids, and whether it is one."""
        if not len(self.hot):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
        return at, self.hot[at] == ids

    def sums(self, batches):
        """One row for each relation (kind 1) and hot id (0) of a task, and its loss (2)."""
        g = [np.zeros((len(x), self.dim)) for x in (self.hot, self.relations)]
        n = [np.zeros(len(x), np.int64) for x in g]
        loss, weight = 0.0, 0
        for h, r, t, w in self._edges(batches):
            c, e, f, hinge = self._ends(h, r, t, self._firsts(h))
            loss, weight = loss + float((hinge * w).sum()), weight + int(w.sum())
            on = hinge > 0
            h, r, t, c, w, e, f = (x[on] for x in (h, r, t, c, w, e, f))
            k = w[:, None]
            both = 2 * (e - f) * k
            _add(g[1], n[1], r, both, w)
            for ids, pull in ((h, both), (t, -2 * e * k), (c, 2 * f * k)):
                at, hit = self._hot_at(ids)
                _add(g[0], n[0], at[hit], pull[hit], w[hit])
        rows = [(kind, int(i), list(x), int(m), 0.0) for kind, ids in enumerate((self.hot, self.relations)) for i, x, m in zip(ids, g[kind], n[kind]) if m]
        if weight:
            rows.append((2, 0, [0.0] * self.dim, weight, loss))
        types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], x) for i, x in enumerate(types)], ["kind", "id", "g", "n", "loss"])

    def _packed(self, kind: int, ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        """One row for each block, its ids' rows column by column."""
        block = ids % self.blocks
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        parts = [x.astype(kept.base)[order] for x, kept in zip((ids // self.blocks, *columns), self.columns[kind])]
        data = [b"".join(x[a:b].tobytes() for x in parts) for a, b in zip(starts, np.append(starts[1:], len(ids)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[starts], pa.int32()), pa.array(np.full(len(starts), kind), pa.int32()), pa.array(data, pa.binary())], ["block", "kind", "data"])

    def _unpacked(self, table: pa.Table, kind: int) -> list[np.ndarray]:
        columns = self.columns[kind]
        found = [[] for _ in columns]
        for data in table["data"].filter(pc.equal(table["kind"], kind)).to_pylist():
            n, at = len(data) // sum(x.itemsize for x in columns), 0
            for out, column in zip(found, columns):
                out.append(np.frombuffer(data, column.base, n * column.itemsize // column.base.itemsize, at).reshape(n, *column.shape))
                at += n * column.itemsize
        empty = lambda column: np.zeros((0, *column.shape), column.base)
        whole = [np.concatenate(x) if x else empty(column) for x, column in zip(found, columns)]
        return [x.astype(np.int64) if x.dtype.kind in "iu" else x for x in whole]

    def send(self, batches):
        """Edges to their heads' blocks, and pulls of active edges to those of tails and wrong tails, as ids."""
        for h, r, t, w in self._edges(batches):
            c, _, _, hinge = self._ends(h, r, t, self._firsts(h))
            cold = ~self._hot_at(h)[1]
            yield self._packed(EDGES, h[cold], r[cold], t[cold], w[cold])
            for ids, sign in ((t, -1), (c, 1)):
                on = (hinge > 0) & ~self._hot_at(ids)[1]
                yield self._packed(PULLS, ids[on], h[on], r[on], sign * w[on])

    def _ids(self, block: int) -> np.ndarray:
        return np.arange(block, self.entities, self.blocks)

    def _vectors(self, block: int, got: pa.Table) -> np.ndarray:
        """A block's vectors after the first epoch."""
        ids = self._ids(block)
        first = self._first(ids)
        g, n = np.zeros(first.shape), np.zeros(len(ids), np.int64)
        at, r, t, w = self._unpacked(got, EDGES)
        _, e, f, hinge = self._ends(ids[at], r, t, first[at])
        on = hinge > 0
        _add(g, n, at[on], (2 * (e - f) * w[:, None])[on], w[on])
        at, h, r, w = self._unpacked(got, PULLS)
        _add(g, n, at, 2 * (self._firsts(h) + self.first_r[r] - first[at]) * w[:, None], np.abs(w))
        vecs = self._step(first, g, n)
        mine = np.flatnonzero(self.hot % self.blocks == block)
        vecs[self.hot[mine] // self.blocks] = self.hot_v[mine]
        return vecs

    def vectors(self, block: int, got: pa.Table) -> pa.Table:
        vecs = self._vectors(block, got)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1) * self.dim, pa.int32()), pa.array(vecs.ravel()))
        return pa.table({"id": self._ids(block), "vec": lists})

    def _ask(self, h: np.ndarray, r: np.ndarray, t: np.ndarray, w: np.ndarray, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        """h + r of the second epoch to the wrong tail, where the tail is known, else to the tail."""
        c = wrong_tails(h, self.relations[r], t, self.entities, 2)
        sums = heads + self.next_r[r]
        at, hot = self._hot_at(t)
        yield self._packed(WRONG, c[hot], w[hot], _square(sums[hot] - self.hot_v[at[hot]]), sums[hot])
        yield self._packed(TAILS, t[~hot], c[~hot], w[~hot], sums[~hot])

    def heads(self, block: int, got: pa.Table) -> pa.Table:
        at, r, t, w = self._unpacked(got, EDGES)
        return pa.Table.from_batches(list(self._ask(self._ids(block)[at], r, t, w, self._vectors(block, got)[at])))

    def hot_heads(self, batches):
        """The edges that no block has: an end of very many edges may be the head of few."""
        hot = pa.array(self.hot)
        for h, r, t, w in self._edges(batch.filter(pc.is_in(batch["h"], value_set=hot)) for batch in batches):
            yield from self._ask(h, r, t, w, self.hot_v[self._hot_at(h)[0]])

    def _loss(self, vecs: np.ndarray, asked: pa.Table) -> tuple[float, int]:
        at, w, right, sums = self._unpacked(asked, WRONG)
        return float((np.maximum(0.0, self.margin + right - _square(sums - vecs[at])) * w).sum()), int(w.sum())

    def tails(self, block: int, got: pa.Table, asked: pa.Table) -> pa.Table:
        """Losses of what is known, and h + r on to the wrong tails."""
        vecs = self._vectors(block, got)
        loss, n = self._loss(vecs, asked)
        at, c, w, sums = self._unpacked(asked, TAILS)
        onward = self._packed(WRONG, c, w, _square(sums - vecs[at]), sums)
        return pa.Table.from_batches([onward, self._packed(LOSS, np.array([block]), np.array([loss]), np.array([n]))])

    def wrong(self, block: int, got: pa.Table, asked: pa.Table) -> pa.Table:
        loss, n = self._loss(self._vectors(block, got), asked)
        _, more, count = self._unpacked(asked, LOSS)
        return pa.table({"loss": [loss + float(more.sum())], "n": [n + int(count.sum())]})
