"""Exact Jaccard self-join of documents as sets of word shingles (operator 7), by set-relation skipping.

The answer is the connected components of "share at least three quarters of their union".

* Equal sets are one class; only its first document goes on.
* A class finds the leader that it shares most MinHash bands with. The pair's similarity is then computed from the two texts; a
  class that shares nine tenths with a leader joins the leader's ball, and its radius is known.
* Index lists: a set's shingles are ordered by hash, frequent ones last; a set is listed under the first
  quarter of them. Entries carry their position, and in long lists whole blocks are skipped where even
  the best position leaves too few shingles for the overlap that two sets need.
* Before texts are fetched, a pair's sets are held against each other by their parities: as many bits as two to
  four times the set, each telling whether an odd number of shingles falls there. Bits that differ are fewer than
  the shingles that only one set has, so they bound the overlap; only pairs that may link by it are compared.
* Lists that hold a single component are dropped where they are made. In the others neighbours are compared
  first and connected, round by round, while half of them link. Then the entries of lists that still hold pairs to be
  decided get their balls' parities (folded to ``BITS`` bytes), and a list gives only pairs whose parities leave room for
  a link of theirs or of their balls' members: first, by rounds, each ball's most similar partner, at last all of them.
* A ball is one entry of a list. Its answers are derived from those of its leader: leaders that link join
  their balls; leaders further apart than the radii allow rule out every pair of their members; only
  between these bounds are members compared, and only where the balls are not connected already.

No step emits all pairs of a group: within a ball, and within what is already connected, none are.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidra.llm.common import batch, lookup_bounded, mixed, written
from evidra.llm.components import components
from evidra.llm.textcols import Texts, shingles_of, slices, texts_of, words_of

WORDS = 5
BANDS, ROWS = 4, 3
#: Partners that a ball is compared with in a round of neighbours; the last round has no such bound.
PARTNERS = 2
#: A shingle that is met this often is listed last, as far as the table of the most frequent ones goes.
FREQUENT, FREQUENT_MOST = 32, 1 << 18
#: Shingles, by the upper half of their hash, that a task looks through together for repeats.
CHUNK = 4_000_000
#: Index entries that a task holds before it hands them on, and candidate pairs likewise.
HELD, HELD_PAIRS = 250_000, 100_000
SLICE = 1 << 20
BUCKET_ENTRIES = 400_000
BLOCK = 128
#: Bytes of a ball's parities that go with its entries, and pairs whose parities are held against each other at once.
BITS, AT_ONCE = 256, 1 << 16
SKETCH = "kind int, doc_id long, rid long, key binary, n long, bits binary, " + ", ".join(f"b{i} long" for i in range(BANDS))
ENTRY = "token long, ball long, comp long, low long, high long, rest long"


def prefix_length(n: np.ndarray | int):
    """Of two linked sets in one order, each has one of its first so many among the other's."""
    return n - (3 * n + 3) // 4 + 1


def needed(n, m):
    """Seven times the least overlap of linked sets of sizes ``n`` and ``m``."""
    return 3 * (n + m)


def linked(common, n, m):
    """common / union >= 0.75."""
    return 100 * common >= 75 * (n + m - common)


def sets_of(texts: Texts) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    flat, sizes = shingles_of(words_of(texts), WORDS)
    ends = np.cumsum(sizes)
    return [np.unique(flat[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]


def _bands(hashes: np.ndarray) -> list[int]:
    """Hashes of ``ROWS`` minima each, over ``BANDS * ROWS`` residues of the hashes (a full value each)."""
    k = BANDS * ROWS
    least = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            least[i] = (hashes * np.uint64(2 * i + 3) ^ (hashes >> np.uint64(29 + i % 5))).min()
        return [int.from_bytes(hashlib.blake2b(least[i::BANDS].tobytes() + bytes([i]), digest_size=8).digest(), "little", signed=True) for i in range(BANDS)]


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes falls on each of a power of two of places, at least two for each."""
    places = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def most_common(a: bytes, b: bytes, n: int, m: int) -> int:
    """The most that sets of sizes ``n`` and ``m`` can share by their parities; the longer ones are folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    differ = np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum()
    return min(n, m, (n + m - int(differ)) // 2)


def folded(bits: bytes) -> bytes:
    """Parities of at most ``BITS`` bytes."""
    return bits if len(bits) <= BITS else np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, BITS), axis=0).tobytes()


def _upper(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _sketch(batches):
    """A row per document (kind 0), and the shingles met twice or more in a run of documents (kind 1)."""
    held, size = [], 0

    def repeated():
        flat = np.concatenate(held)
        held.clear()
        flat.sort()
        values, counts = np.unique(flat[1:][flat[1:] == flat[:-1]], return_counts=True)
        n = len(values)
        none = pa.nulls(n, pa.int64())
        return batch(SKETCH, np.ones(n, np.int32), none, values.astype(np.int64), pa.nulls(n, pa.binary()), counts + 1, pa.nulls(n, pa.binary()), *[none] * BANDS)

    for rows in batches:
        for part in slices(rows, "text", SLICE):
            sets = sets_of(texts_of(part.column("text")))
            keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            bands = [_bands(s) if len(s) else [None] * BANDS for s in sets]
            yield batch(
                SKETCH, np.zeros(len(sets), np.int32), part.column("doc_id"), part.column("rid"), keys, [len(s) for s in sets],
                [parities(s) if len(s) else None for s in sets], *[[b[i] for b in bands] for i in range(BANDS)],
            )
            held += [_upper(s) for s in sets]
            size += sum(map(len, sets))
            if size >= CHUNK:
                yield repeated()
                size = 0
    if held:
        yield repeated()


def _pack(token: np.ndarray, at: np.ndarray, pos: np.ndarray, balls: np.ndarray, comps: np.ndarray, sizes: np.ndarray) -> bytes:
    """Entries of one bucket: the documents once, then token, document and position of each entry."""
    doc, at = np.unique(at, return_inverse=True)
    wide = "<u2" if len(doc) < 1 << 16 else "<u4"
    far = "<u2" if pos.max() < 1 << 16 else "<u4"
    head = struct.pack("<IIBB", len(doc), len(token), int(wide[-1]), int(far[-1]))
    parts = balls[doc].astype("<i8"), comps[doc].astype("<i8"), sizes[doc].astype("<u4"), token.astype("<u8"), at.astype(wide), pos.astype(far)
    return head + b"".join(p.tobytes() for p in parts)


def _unpack(data: bytes):
    docs, n, wide, far = struct.unpack_from("<IIBB", data)
    at = 10
    out = []
    for kind, count in (("<i8", docs), ("<i8", docs), ("<u4", docs), ("<u8", n), (f"<u{wide}", n), (f"<u{far}", n)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    ball, comp, size, token, which, pos = out
    size = size[which].astype(np.int64)
    return token, ball[which], comp[which], size, size, size - pos


def _prefixes(frequent: np.ndarray):
    """A row per document: the shingles that it is listed under, in order."""

    def prefix(batches):
        for rows in batches:
            for part in slices(rows, "text", SLICE):
                rids, sizes, data = [], [], []
                for s, rid in zip(sets_of(texts_of(part.column("text"))), part.column("rid").to_pylist()):
                    if not len(s):
                        continue
                    rids.append(rid)
                    sizes.append(len(s))
                    p = prefix_length(len(s))
                    if len(frequent):
                        upper = _upper(s)
                        often = frequent[np.minimum(np.searchsorted(frequent, upper), len(frequent) - 1)] == upper
                        s = np.concatenate([s[~often], s[often]])
                    data.append(s[:p].astype("<u8").tobytes())
                yield batch(PREFIX, rids, sizes, data)

    return prefix


def prefixes_of(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(rid, n, data) of each class's first document, with the columns of ``classes``; copies go before any
    list is made."""
    rows = docs.mapInArrow(_prefixes(frequent), PREFIX)
    return rows.join(classes, "rid").dropDuplicates(["rid"])


def _collapsed(token: np.ndarray, ball: np.ndarray, comp: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray):
    """One entry for each (token, ball): its smallest and largest set, and the most that may lie ahead."""
    order = np.lexsort((ball, token))
    token, ball = token[order], ball[order]
    heads = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (ball[1:] != ball[:-1])]))
    least, most, ahead = np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads), np.maximum.reduceat(rest[order], heads)
    return token[heads], ball[heads], comp[order][heads], least, most, ahead


def _entries(bits: int):
    def index(batches):
        held: list[np.ndarray] = []
        info: list[tuple[int, int, int]] = []
        count = 0

        def flush():
            token = np.concatenate(held)
            lengths = np.array([len(x) for x in held])
            at = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
            pos = (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            bucket = (token >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(token), np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            begins = np.concatenate([[0], cut])
            docs = [np.array(x, np.int64) for x in zip(*info)]
            packed = [_pack(token[o], at[o], pos[o], *docs) for o in np.split(order, cut)]
            held.clear(), info.clear()
            return batch("bucket int, data binary", bucket[begins], packed)

        for rows in batches:
            for ball, comp, n, data in zip(*(rows.column(c).to_pylist() for c in ("ball", "comp", "n", "data"))):
                held.append(np.frombuffer(data, "<u8"))
                info.append((ball, comp, n))
                count += len(held[-1])
                if count >= HELD:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return index


def _opened(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's lists that hold more than one component, one entry for each ball of a list."""
    held: list[tuple] = []
    for rows in batches:
        for data in rows.column("data").to_pylist():
            held.append(_collapsed(*_unpack(data)))
            if len(held) > 1 and sum(len(x[0]) for x in held[1:]) > len(held[0][0]) + BUCKET_ENTRIES:
                held = [_collapsed(*(np.concatenate(x) for x in zip(*held)))]
    token, ball, comp, low, high, rest = _collapsed(*(np.concatenate(x) for x in zip(*held)))
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    several = np.minimum.reduceat(comp, heads) != np.maximum.reduceat(comp, heads)
    keep = np.repeat(several, np.diff(np.append(heads, len(token))))
    for at in range(0, int(keep.sum()), HELD_PAIRS):
        part = np.flatnonzero(keep)[at : at + HELD_PAIRS]
        yield batch(ENTRY, token[part].view(np.int64), ball[part], comp[part], low[part], high[part], rest[part])


PAIR = "a long, b long"
MET = f"{PAIR}, times long"
PREFIX = "rid long, n long, data binary"


def _list_places(rows: dict[str, np.ndarray]):
    """Places of the pairs of one list's entries that the positions and sizes allow and that are not connected yet.

    Entries are sorted by size; blocks whose sizes lie too far apart, or whose best positions leave too
    little, are skipped whole.
    """
    comp, low, high, rest = (rows[c] for c in ("comp", "low", "high", "rest"))
    m = len(comp)
    starts = np.arange(0, m, BLOCK)
    least, most, best = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(rest, starts)
    for i, a in enumerate(starts.tolist()):
        x = slice(a, a + BLOCK)
        for j, b in enumerate(starts[i:].tolist(), i):
            if 4 * most[i] < 3 * least[j] or 7 * min(best[i], best[j]) < needed(least[i], least[j]):
                continue
            y = slice(b, b + BLOCK)
            ok = comp[x, None] != comp[None, y]
            ok &= (4 * high[x, None] >= 3 * low[None, y]) & (4 * high[None, y] >= 3 * low[x, None])
            ok &= 7 * np.minimum(rest[x, None], rest[None, y]) >= needed(low[x, None], low[None, y])
            if i == j:
                ok = np.triu(ok, 1)
            p, q = np.nonzero(ok)
            if len(p):
                yield a + p, b + q


def _list_pairs(rows: dict[str, np.ndarray]):
    """The pairs of balls at :func:`_list_places`."""
    for p, q in _list_places(rows):
        yield np.stack([rows["ball"][p], rows["ball"][q]], 1)


def _neighbours(batches):
    """Of each list only the pairs of neighbours by ball that are not connected and may link: fewer than entries.

    All lists have their balls in one order, so balls that share much are neighbours again and again, and what
    links them is found by few pairs; the pairs of what is then connected never come up.
    """
    names = ("token", "ball", "comp", "low", "high", "rest")
    before = None
    for rows in batches:
        if not rows.num_rows:
            continue
        cols = {c: rows.column(c).to_numpy() for c in names}
        if before is not None:
            cols = {c: np.concatenate([before[c], v]) for c, v in cols.items()}
        before = {c: v[-1:] for c, v in cols.items()}
        x, y = {c: v[:-1] for c, v in cols.items()}, {c: v[1:] for c, v in cols.items()}
        ok = (x["token"] == y["token"]) & (x["comp"] != y["comp"])
        ok &= (4 * x["high"] >= 3 * y["low"]) & (4 * y["high"] >= 3 * x["low"])
        ok &= 7 * np.minimum(x["rest"], y["rest"]) >= needed(x["low"], y["low"])
        pairs, times = np.unique(np.stack([x["ball"][ok], y["ball"][ok]], 1), axis=0, return_counts=True)
        yield batch(MET, pairs[:, 0], pairs[:, 1], times)


def _whole_lists(batches, names: tuple[str, ...]):
    """Columns of whole lists from rows sorted by token; a list may go over several batches."""
    held: dict[str, list] = {c: [] for c in names}
    for rows in batches:
        if not rows.num_rows:
            continue
        for c in names:
            held[c].append(np.array(rows.column(c).to_pylist(), object) if c == "bits" else rows.column(c).to_numpy())
        token = rows.column("token").to_numpy()
        if token[0] == token[-1] == held["token"][0][0]:
            continue  # one list so far
        full = {c: np.concatenate(held[c]) for c in names}
        last = int(np.searchsorted(full["token"], full["token"][-1]))
        if last:
            yield {c: v[:last] for c, v in full.items()}
        held = {c: [v[last:]] for c, v in full.items()}
    if held["token"]:
        yield {c: np.concatenate(v) for c, v in held.items()}


def _open_places(rows: dict[str, np.ndarray]):
    """Places of all pairs in the same of several lists that may link by positions and sizes and are not connected."""
    cut = np.flatnonzero(np.diff(rows["token"])) + 1
    ends = np.append(cut, len(rows["token"]))
    begins = np.concatenate([[0], cut])
    size = ends - begins
    comp, low, high, rest = (rows[c] for c in ("comp", "low", "high", "rest"))
    for n in np.unique(size[(size > 1) & (size <= 16)]).tolist():  # short lists side by side
        at = begins[size == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        x, y = at[:, i].ravel(), at[:, j].ravel()
        ok = (comp[x] != comp[y]) & (4 * high[x] >= 3 * low[y]) & (4 * high[y] >= 3 * low[x])
        ok &= 7 * np.minimum(rest[x], rest[y]) >= needed(low[x], low[y])
        yield x[ok], y[ok]
    for a, b in zip(begins[size > 16].tolist(), ends[size > 16].tolist()):
        order = np.argsort(low[a:b], kind="stable") + a
        for p, q in _list_places({c: rows[c][order] for c in ("comp", "low", "high", "rest")}):
            yield order[p], order[q]


def _undecided(batches):
    """The entries that have a partner at :func:`_open_places`."""
    names = ("token", "ball", "comp", "low", "high", "rest")
    for rows in _whole_lists(batches, names):
        has = np.zeros(len(rows["token"]), bool)
        for x, y in _open_places(rows):
            has[x] = has[y] = True
        yield batch(ENTRY, *(rows[c][has] for c in names))


def _folds(bits: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Each row's number of parity words, and by number of words the rows of at least as many, folded to it."""
    words = np.array([len(x) for x in bits], np.int64) // 8
    folds, above, w = {}, None, BITS // 8
    while w:
        now = np.zeros((len(bits), w), np.uint64)
        if above is not None:
            now ^= above[:, :w] ^ above[:, w:]
        own = np.flatnonzero(words == w)
        if len(own):
            now[own] = np.frombuffer(b"".join(bits[own]), np.uint64).reshape(-1, w)
        folds[w] = above = now
        w //= 2
    return words, folds


def _likeness(rows: dict[str, np.ndarray], words: np.ndarray, folds: dict[int, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that the similarity of the balls' leaders at ``x`` and ``y`` can be by their parities."""
    width = np.minimum(words[x], words[y])
    differ = np.zeros(len(x), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for part in (at[k : k + AT_ONCE] for k in range(0, len(at), AT_ONCE)):
            differ[part] = np.bitwise_count(folds[w][x[part]] ^ folds[w][y[part]]).sum(1)
    n, m = rows["n"][x], rows["n"][y]
    common = np.minimum(np.minimum(n, m), (n + m - differ) // 2)
    return common / (n + m - common)


def _pairs(best: bool):
    """Pairs of balls, in order, that may link or have members that may; with ``best`` each ball's likest partner only."""

    def pairs(batches):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            a, b, like = (np.concatenate(x) for x in zip(*found))
            found.clear()
            if best:
                a, b, like = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(like, 2)
                order = np.lexsort((b, -like, a))
                order = order[np.unique(a[order], return_index=True)[1]]
                return batch(MET, a[order], b[order], (like[order] * 1e6).astype(np.int64))
            some = np.unique(np.sort(np.stack([a, b], 1), 1), axis=0)
            return batch(MET, some[:, 0], some[:, 1], np.zeros(len(some), np.int64))

        for rows in _whole_lists(batches, ("token", "ball", "comp", "low", "high", "rest", "n", "away", "bits")):
            words, folds = _folds(rows["bits"])
            for x, y in _open_places(rows):
                like = _likeness(rows, words, folds, x, y)
                ok = 1 - like <= 0.25 + rows["away"][x] + rows["away"][y] + 1e-9
                if ok.any():
                    found.append((rows["ball"][x[ok]], rows["ball"][y[ok]], like[ok]))
                if sum(len(f[0]) for f in found) > HELD_PAIRS:
                    yield flush()
        if found:
            yield flush()

    return pairs


def _folded(batches):
    for rows in batches:
        yield batch(BRIEF, rows.column("ball"), rows.column("n"), rows.column("away"), [folded(x) for x in rows.column("bits").to_pylist()])


BRIEF = "ball long, n long, away double, bits binary"
VERIFIED = "a long, b long, common long, n long, m long"


def _bounded(batches):
    """The most that each row's two sets may share."""
    for rows in batches:
        a, b, n, m, left, right = (rows.column(c) for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b"))
        common = [
            most_common(x.as_buffer(), y.as_buffer(), i, j) for x, y, i, j in zip(left, right, n.to_pylist(), m.to_pylist())
        ]
        yield batch(VERIFIED, a, b, common, n, m)


def _compare(batches):
    """The overlap of each row's two texts."""
    for rows in batches:
        for part in slices(rows, "text_a", SLICE):
            left = sets_of(texts_of(part.column("text_a")))
            b = part.column("b").to_numpy()
            ids, first, which = np.unique(b, return_index=True, return_inverse=True)
            right = sets_of(texts_of(part.column("text_b").take(pa.array(first))))
            common = [len(np.intersect1d(x, right[i], assume_unique=True)) for x, i in zip(left, which.tolist())]
            yield batch(VERIFIED, part.column("a"), part.column("b"), common, [len(x) for x in left], [len(right[i]) for i in which.tolist()])


def compared(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Overlaps of pairs of documents (a, b), whose texts are fetched by ``rid``; written.

    ``sets(rid, n, bits)`` has sizes and parities. Of pairs that cannot link by their parities ``common`` is the
    bound and no text is fetched. The texts of ``a`` travel with their pair to the text of ``b``, so give the side
    that few pairs share as ``a``.
    """
    for side in "ab":  # the same columns renamed, so both sides share one exchange
        pairs = pairs.join(sets.select(F.col("rid").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    bounds = written(pairs.mapInArrow(_bounded, VERIFIED))
    may = linked(F.col("common"), F.col("n"), F.col("m"))
    pairs = bounds.where(may).select("a", "b")
    ids = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    texts = docs.join(ids, "rid", "left_semi").dropDuplicates(["rid"])
    left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
    exact = written(full.select("a", "b", "text_a", "text_b").sortWithinPartitions("b").mapInArrow(_compare, VERIFIED))
    return exact.unionByName(bounds.where(~may))


def _rooted(links: DataFrame) -> DataFrame:
    """(node, root) of the components of links from members (a) to their leaders (b).

    A member hangs on its least leader, which stands for it; its other leaders are tied to that one. Only
    the leaders, far fewer than the members, go through the rounds of :func:`components`.
    """
    links = written(links)
    least = written(links.groupBy("a").agg(F.min("b").alias("p")))
    leaders = links.select(F.col("b").alias("a")).distinct()
    ties = links.join(least, "a").where("b <> p").select(F.col("b").alias("a"), F.col("p").alias("b"))
    ties = ties.union(least.join(leaders, "a", "left_semi").select("a", F.col("p").alias("b")))
    roots = components(ties.distinct())
    hung = least.join(leaders, "a", "left_anti").join(roots.withColumnRenamed("node", "p"), "p", "left")
    hung = hung.select(F.col("a").alias("node"), F.coalesce("root", "p").alias("root"))
    alone = leaders.select(F.col("a").alias("node")).join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return written(hung.unionByName(roots).unionByName(alone))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after further links, which are drawn between the roots so far."""
    def end(c: str) -> DataFrame:
        return roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))

    links = written(links.join(end("a"), "a", "left").join(end("b"), "b", "left"))
    ends = written(links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct())
    over = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = over.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
    return written(known.unionByName(fresh))


def similar_documents(docs: DataFrame) -> DataFrame:
    """Every row's component; see :func:`components_of`, which also says which row is which."""
    return components_of(docs).select("doc_id", "n_shingles", "component_id")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: of those with the smallest doc_id, the one with the
    smallest hash of id and text. Rows with an empty set all stay."""
    found = components_of(docs)
    stay = found.where("first OR n_shingles = 0").select(F.col("rid").alias("_rid")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = docs.select(row, F.xxhash64("doc_id", "text").alias("_rid"), (F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\u000b\f\r", "     ")) != "").alias("_set"))
    kept = marked.join(stay, "_rid", "left_semi")
    # Rows equal in id and text are copies of each other: one of them stays, whatever their other columns.
    once = kept.where("_set").dropDuplicates(["_rid"]).select("_row.*")
    return once.unionByName(kept.where("NOT _set").select("_row.*"))


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, first, n_shingles, component_id) of every row; ``rid`` is the hash of its id and text,
    and ``first`` marks the row that stands for its component.

    A null or blank text has an empty set and is linked with nothing, its component_id is its own
    doc_id; a text of fewer than five words has its whole sequence as one shingle. Null ids count as the
    largest: a component of rows without ids has a null component_id. Repeated rows are copies. An empty
    table gives no rows; only doc_id and text are read. Shingles and rows are told apart by 64-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    sketch = written(docs.mapInArrow(_sketch, SKETCH))
    rows = sketch.where("kind = 0").drop("kind")
    bands = [f"b{i}" for i in range(BANDS)]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("_f")
    classes = written(
        rows.where("n > 0").groupBy("key").agg(first, F.count("*").alias("size"), *[F.min(c).alias(c) for c in ("n", "bits", *bands)])
        .select("key", F.col("_f.doc_id").alias("doc_id"), F.col("_f.rid").alias("rid"), "size", "n", "bits", *bands)
    )

    sets = classes.select("rid", "n", "bits")

    # Balls: leaders by band, then exact similarity.
    listed = classes.select("rid", "n", F.posexplode(F.array(*bands)).alias("i", "b")).select("rid", "n", F.xxhash64("i", "b").alias("band"))
    leaders = listed.groupBy("band").agg(F.min(F.struct("rid", "n")).alias("lead"), F.count("*").alias("members")).where("members > 1")
    met = written(lookup_bounded(listed, leaders, "band", F.col("members")).where("lead is not null").select("rid", "n", "lead"))
    # A member meets only the leader that it has most bands in common with; others meet in the lists.
    met = met.where("rid <> lead.rid AND 4 * n >= 3 * lead.n AND 4 * lead.n >= 3 * n").groupBy("rid", "n", "lead").agg(F.count("*").alias("times"))
    met = met.groupBy("rid").agg(F.max_by("lead", F.struct("times", -F.col("lead.n"), "lead.rid")).alias("lead"))
    near = compared(met.select(F.col("rid").alias("a"), F.col("lead.rid").alias("b")).distinct(), docs, sets)
    first_roots = _rooted(near.where(linked(F.col("common"), F.col("n"), F.col("m"))).select("a", "b"))
    union = F.col("n") + F.col("m") - F.col("common")
    close = near.where(10 * F.col("common") >= 9 * union).withColumn("away", 1 - F.col("common") / union)
    followers = close.select(F.col("a").alias("b")).distinct()
    stars = close.join(followers, "b", "left_anti").groupBy("a").agg(F.min(F.struct("b", "away")).alias("s"))
    stars = written(stars.select(F.col("a").alias("rid"), F.col("s.b").alias("ball"), F.col("s.away").alias("away")))

    # Index lists over all classes, frequent shingles last.
    often = sketch.where("kind = 1").groupBy("rid").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "rid").limit(FREQUENT_MOST)  # only an order: any set gives the same answer
    frequent = np.sort(np.array([r[0] for r in often.select("rid").collect()], np.int64).astype(np.uint32))
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(total // 4 // BUCKET_ENTRIES)).bit_length()
    info = (
        classes.select("rid").join(stars.select("rid", "ball"), "rid", "left")
        .join(first_roots.withColumnRenamed("node", "rid"), "rid", "left")
        .select("rid", F.coalesce("ball", "rid").alias("ball"), F.coalesce("root", "rid").alias("comp"))
    )
    blobs = prefixes_of(docs, info, frequent).mapInArrow(_entries(bits), "bucket int, data binary")
    lists = written(blobs.groupBy("bucket").applyInArrow(_opened, ENTRY))

    # Rounds: neighbours are compared and what links is contracted, so a connected group's pairs never arise.
    # When less than half of a round's pairs link, the entries of open lists are held against each other by their
    # parities: balls meet their likest partners while half of these link, then all pairs that may link are compared.
    radius = written(stars.groupBy("ball").agg(F.max("away").alias("radius")))
    roots, far, way = first_roots, None, "neighbours"
    while not lists.isEmpty():
        tops = roots.select(F.col("node").alias("ball"), "root")
        dealt = lists.drop("comp").join(tops, "ball", "left").withColumn("comp", F.coalesce("root", "ball")).select(*lists.columns)
        if way == "neighbours":
            dealt = dealt.repartition("token").sortWithinPartitions("token", "ball")
            pairs = dealt.mapInArrow(_neighbours, MET).groupBy("a", "b").agg(F.sum("times").alias("times"))
            most = PARTNERS
        else:
            # The lists' entries that are left to decide; each round has fewer of them.
            lists = written(dealt.repartition("token").sortWithinPartitions("token").mapInArrow(_undecided, ENTRY))
            brief = sets.withColumnRenamed("rid", "ball").join(lists.select("ball").distinct(), "ball", "left_semi")
            brief = brief.join(radius, "ball", "left").select("ball", "n", F.coalesce("radius", F.lit(0.0)).alias("away"), "bits")
            full = lists.join(brief.mapInArrow(_folded, BRIEF), "ball").select(*lists.columns, "n", "away", "bits")
            full = full.repartition("token").sortWithinPartitions("token")
            pairs = full.mapInArrow(_pairs(way == "best"), MET).groupBy("a", "b").agg(F.max("times").alias("times"))
            most = 1
        if way != "all":
            often = Window.partitionBy("a").orderBy(F.desc("times"), "b")
            pairs = pairs.withColumn("_r", F.row_number().over(often)).where(F.col("_r") <= most)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if far is not None:
            pairs = pairs.join(far.select("a", "b"), ["a", "b"], "left_anti")
        met = compared(pairs, docs, sets)
        far = met if far is None else far.unionByName(met)
        links = met.where(linked(F.col("common"), F.col("n"), F.col("m"))).select("a", "b")
        found, tried = links.count(), met.count()
        if found:
            roots = _joined(roots, links)
        if way == "all":
            break
        if 2 * found < tried or not tried:
            way = "best" if way == "neighbours" else "all"

    # Balls whose leaders do not link but whose members may, unless they are connected by now.
    far = spark.createDataFrame([], VERIFIED) if far is None else far
    apart = (
        far.withColumn("away", 1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).where("away > 0.25")
        .join(radius.withColumnsRenamed({"ball": "a", "radius": "ra"}), "a", "left")
        .join(radius.withColumnsRenamed({"ball": "b", "radius": "rb"}), "b", "left")
        .where("away <= 0.25 + coalesce(ra, 0) + coalesce(rb, 0) + 1e-9")
        .join(roots.withColumnsRenamed({"node": "a", "root": "qa"}), "a", "left")
        .join(roots.withColumnsRenamed({"node": "b", "root": "qb"}), "b", "left")
        .where("coalesce(qa, a) <> coalesce(qb, b)").select("a", "b", "away")
    )
    apart = written(apart)
    if not apart.isEmpty():
        members = stars.select("ball", "rid", "away").unionByName(
            stars.select("ball").distinct().select("ball", F.col("ball").alias("rid"), F.lit(0.0).alias("away"))
        )
        side = [members.withColumnsRenamed({"ball": s, "rid": f"x{s}", "away": f"d{s}"}) for s in "ab"]
        pairs = apart.join(side[0], "a", "left").join(side[1], "b", "left").select(
            "away", *[F.coalesce(f"x{s}", s).alias(f"x{s}") for s in "ab"], *[F.coalesce(f"d{s}", F.lit(0.0)).alias(f"d{s}") for s in "ab"]
        )
        pairs = pairs.where("away <= 0.25 + da + db + 1e-9 AND da + db > 0").select(F.col("xa").alias("a"), F.col("xb").alias("b"))
        inner = compared(pairs.distinct(), docs, sets)
        roots = _joined(roots, inner.where(linked(F.col("common"), F.col("n"), F.col("m"))).select("a", "b"))

    # Back from roots to classes to rows.
    placed = classes.select("key", "doc_id", "rid", "size").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    placed = written(placed.select("key", "doc_id", "rid", "size", F.coalesce("root", "rid").alias("root")))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    heads = placed.groupBy("root").agg(head.alias("head"), F.count("*").alias("classes"))
    named = lookup_bounded(placed.select("key", "size", "root"), heads, "root", F.col("classes"))
    out = lookup_bounded(rows.select("doc_id", "rid", "n", "key"), named.select("key", "head", "size"), "key", F.col("size"))
    alone = F.col("n") == 0
    return out.select(
        "doc_id", "rid", (~alone & (F.col("rid") == F.col("head.rid"))).alias("first"), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
    )
