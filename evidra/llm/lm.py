"""Log-likelihood of whole documents by a gated recurrent language model over words (operator 2).

Words are lower-cased runs of non-blanks, and every document ends in an end token. Counts of all words of
the training documents are a distributed table. The network's output softmax is factored: a class, then a
word of the class. The ``VOCABULARY`` most frequent words have places of their own, ``CLASS`` to a class;
every other word goes to one of ``TAILS`` buckets by its length and letters, which form the last class,
and within its bucket has its smoothed share of the counts. A text's score is the sum over all its tokens,
with the network's state carried from window to window, so it is the likelihood of the whole document.

Training documents are dealt by a hash to ``ROUNDS`` rounds of blocks of about ``BLOCK_WORDS`` words, written
once as symbols. In each round every block trains its copy of the shared weights by truncated backpropagation,
its documents in the order of their hashes; the copies are averaged by the words they saw. So each document is
learned from once, training grows with the input as the counts do, and the scores do not follow the layout of
the input. (Only rows that repeat both id and text are dealt by where they stand, so that they fill no block.)
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evidra.llm import gru
from evidra.llm.common import batch, crc_part, mixed, written
from evidra.llm.textcols import Words, slices, texts_of, words_of

UNITS = 32
CLASS, CLASSES = 64, 32
VOCABULARY = CLASS * CLASSES - 1  # place 0 is the end of a document
TAILS = 27
#: Counts of so many most frequent words, at most, go to the tasks; those of the others are joined.
HEAD = 1 << 20
ROUNDS = 3
BLOCK_WORDS = 1_000_000
LANES, WINDOW = 1024, 32
TRAIN_LANES, TRAIN_WINDOW, TRAIN_STEPS, RATE = 256, 24, 32, 0.02
FAN_IN = 64
_LN10 = math.log(10)
COUNT = "h long, tail int, c long"
PART = "kind int, uid long, doc_id long, held boolean, h long, n long, known long, base double, score double"
WEIGHTS = "part long, words long, data binary"
SYMBOLS = "round long, block long, hash long, symbols binary"


def tails_of(raw: np.ndarray, w: Words) -> np.ndarray:
    """The bucket of every word: three lengths, and no or one of eight kinds of letters beyond ASCII."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    beyond = np.where((raw & 0xC0) == 0x80, raw, 0).astype(np.uint8)
    edges = np.stack([w.start, w.end], 1).ravel()
    top = np.maximum.reduceat(np.append(beyond, 0), edges)[::2]
    size = w.end - w.start
    return ((size > 5).astype(np.int64) + (size > 10)) * 9 + np.where(top > 0, 1 + (top & 7), 0)


def _counts(batches):
    held: list[tuple] = []
    size = 0

    def flush():
        h, tail, c = (np.concatenate(x) for x in zip(*held))
        values, first, which = np.unique(h, return_index=True, return_inverse=True)
        sums = np.bincount(which, c, len(values)).astype(np.int64)
        return batch(COUNT, values.view(np.int64), tail[first], sums)

    for rows in batches:
        for part in slices(rows, "text"):
            texts = texts_of(part.column("text"))
            w = words_of(texts)
            values, first, c = np.unique(w.hashed, return_index=True, return_counts=True)
            held.append((values, tails_of(texts.raw, w)[first], c))
            size += len(values)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Vocabulary:
    """What tasks know of the counts: those of frequent words, places in the network, bucket totals."""

    def __init__(self, counts: DataFrame, documents: int):
        bins = F.floor(F.log2("c") * 8).cast("int").alias("bin")
        steps = counts.groupBy(bins).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()  # a few hundred rows
        floor, taken = None, 0
        for r in steps:
            if taken + r.n > HEAD:
                break
            floor, taken = r.bin, taken + r.n
        head = counts.where(bins >= floor).toArrow() if floor is not None else None  # at most HEAD rows
        self.floor, self.bins = floor, bins
        h, c, tail = (head.column(n).to_numpy() if head else np.zeros(0, np.int64) for n in ("h", "c", "tail"))
        order = np.argsort(h.view(np.uint64))
        self.h, self.c, tail = h.view(np.uint64)[order], c[order], tail[order]
        top = np.lexsort((self.h, -self.c))[:VOCABULARY]
        self.place = np.zeros(len(self.h), np.int32)
        self.place[top] = np.arange(1, len(top) + 1)
        self.unigrams = np.zeros(CLASS * CLASSES + TAILS)
        self.unigrams[0] = documents
        self.unigrams[1 : len(top) + 1] = self.c[top]
        totals = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # TAILS rows
        total, distinct = np.zeros(TAILS), np.zeros(TAILS)
        for r in totals:
            total[r.tail], distinct[r.tail] = r.c, r.v
        self.words, self.distinct, self.documents = int(total.sum()) + documents, int(distinct.sum()) + (documents > 0), documents
        np.subtract.at(total, tail[top], self.c[top])
        np.subtract.at(distinct, tail[top], 1)
        self.unigrams[CLASS * CLASSES :] = total + 0.5
        self.tail_log = np.log10(total + 0.5 * (distinct + 1))
        self.all_log = math.log10(self.words + 0.5 * (self.distinct + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "bins"}

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index among the frequent words or -1, place in the network or 0) of every word."""
        if not len(self.h):
            return np.full(len(w.hashed), -1), np.zeros(len(w.hashed), np.int32)
        at = np.minimum(np.searchsorted(self.h, w.hashed), len(self.h) - 1)
        at = np.where(self.h[at] == w.hashed, at, -1)
        return at, np.where(at >= 0, self.place[at], 0)

    def symbols(self, raw: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Network symbols of all texts, each closed by the end symbol; and :meth:`look_up` of the words."""
        at, place = self.look_up(w)
        own = np.where(place > 0, place, CLASS * CLASSES + tails_of(raw, w)).astype(np.int32)
        return np.insert(own, np.cumsum(w.count), 0), at, place


def start_weights(v: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of a network that knows the words' shares and nothing of their order."""
    rng = np.random.default_rng(seed)
    n = CLASS * CLASSES + TAILS
    p = gru.start(rng, n, UNITS)
    share = (v.unigrams + 0.01) / (v.unigrams + 0.01).sum()
    klass = np.add.reduceat(share, np.arange(0, CLASS * CLASSES + 1, CLASS))
    p["class_w"] = np.zeros((UNITS, CLASSES + 1), np.float32)
    p["class_b"] = np.log(klass).astype(np.float32)
    p["word_w"] = rng.normal(0, 0.02, (n, UNITS)).astype(np.float32)
    p["word_b"] = np.log(share / klass[np.arange(n) // CLASS]).astype(np.float32)
    return p


def train(p: dict[str, np.ndarray], symbols: np.ndarray, rate: float = RATE) -> None:
    """One pass over texts joined end to end, in up to ``TRAIN_LANES`` streams; states start anew after an end."""
    if not len(symbols):
        return
    streams = max(1, min(TRAIN_LANES, len(symbols) // (TRAIN_WINDOW * TRAIN_STEPS)))  # few words make few streams
    width = -(-len(symbols) // streams)
    lanes = np.zeros(width * streams, np.int64)
    lanes[: len(symbols)] = symbols
    lanes = lanes.reshape(streams, width).T
    before = np.concatenate([np.zeros((1, streams), np.int64), lanes[:-1]])
    adam, h = gru.Adam(p, rate), np.zeros((streams, UNITS), np.float32)
    steps = -(-width // TRAIN_WINDOW)
    for i in range(steps):
        x, y = (a[i * TRAIN_WINDOW : (i + 1) * TRAIN_WINDOW] for a in (before, lanes))
        keep = (x != 0).astype(np.float32)
        states, kept = gru.run(p, x, h, keep)
        h = states[-1]
        flat, target = states.reshape(-1, UNITS), y.ravel()
        klass, share = target // CLASS, np.float32(1 / target.size)
        d = _softmax(p["class_w"].T @ flat.T + p["class_b"][:, None])
        d[klass, np.arange(len(flat))] -= 1
        d *= share
        d_states = (p["class_w"] @ d).T
        grads = {"class_w": (d @ flat).T, "class_b": d.sum(1), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        order = np.argsort(klass, kind="stable")
        edges = np.searchsorted(klass[order], np.arange(CLASSES + 2))
        ordered, place, d_words = flat[order], target[order] % CLASS, np.empty_like(flat)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b, span = edges[k], edges[k + 1], slice(k * CLASS, min((k + 1) * CLASS, len(p["word_b"])))
            e = _softmax(p["word_w"][span] @ ordered[a:b].T + p["word_b"][span][:, None])
            e[place[a:b], np.arange(b - a)] -= 1
            e *= share
            grads["word_w"][span], grads["word_b"][span] = e @ ordered[a:b], e.sum(1)
            d_words[a:b] = e.T @ p["word_w"][span]
        d_states[order] += d_words
        grads |= gru.back(p, x, kept, d_states.reshape(states.shape), keep)
        adam.update(grads, rate * min(1.0, 2 * (1 - i / steps)))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the rows of each column, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


class Scorer:
    """Log10 probabilities of symbol sequences under given weights."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.reader = p, gru.Reader(p)
        self.class_w = np.ascontiguousarray(p["class_w"].T)

    def score(self, symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The sum for each text; ``symbols`` are the texts one after another, ``count`` long each."""
        begin = np.cumsum(count) - count
        out = np.zeros(len(count))
        order = np.argsort(-count, kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            out[lanes] = self._lanes(symbols, begin[lanes], count[lanes])
        return out / _LN10

    def _lanes(self, symbols: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Natural logs of texts read side by side, longest first; states go on from window to window."""
        sums = np.zeros(len(begin))
        h = np.zeros((UNITS, len(begin)), np.float32)
        last = np.zeros(len(begin), np.int64)
        for t0 in range(0, int(count[0]), WINDOW):
            states, target, lane = [], [], []
            for t in range(t0, min(t0 + WINDOW, int(count[0]))):
                n = int(np.searchsorted(-count, -t, "left"))  # texts longer than t
                if n < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :n])
                h = self.reader.step(last[:n], h)
                last = symbols.take(begin[:n] + t)
                states.append(h)
                target.append(last)
                lane.append(np.arange(n))
            np.add.at(sums, np.concatenate(lane), self._logs(np.concatenate(states, 1), np.concatenate(target)))
        return sums

    def _logs(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        klass = target // CLASS
        order = np.argsort(klass, kind="stable")
        x, target, klass = x[:, order], target[order], klass[order]
        logits = self.class_w @ x
        logits += self.p["class_b"][:, None]
        got = _picked(logits, klass)
        edges = np.searchsorted(klass, np.arange(CLASSES + 2))
        for k in range(CLASSES + 1):
            a, b = edges[k], edges[k + 1]
            if b > a:
                span = slice(k * CLASS, (k + 1) * CLASS)
                logits = self.p["word_w"][span] @ x[:, a:b]
                logits += self.p["word_b"][span][:, None]
                got[a:b] += _picked(logits, target[a:b] - k * CLASS)
        out = np.empty(len(got))
        out[order] = got
        return out


def _picked(logits: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Log softmax over the rows, of one row for each column."""
    picked = logits[row, np.arange(len(row))].astype(np.float64)
    top = logits.max(0)
    logits -= top
    np.exp(logits, out=logits)
    return picked - top - np.log(logits.sum(0))


def packed_weights(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def unpacked_weights(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(data, np.float32, like[k].size, at).reshape(like[k].shape).copy()
        at += out[k].nbytes
    return out


def _averaged(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    words = np.array(rows.column("words").to_pylist(), np.float64)
    total = sum(np.frombuffer(d, np.float32) * np.float64(n) for d, n in zip(rows.column("data").to_pylist(), words))
    mean = (total / words.sum()).astype(np.float32)
    return pa.Table.from_batches([batch(WEIGHTS, [rows.column("part")[0].as_py() // FAN_IN], [int(words.sum())], [mean.tobytes()])])


def dealt(learning: DataFrame, v, blocks: int) -> DataFrame:
    """The symbols of every training document with its round and block; ``learning`` has text and hash."""

    def symbols(batches):
        task, number = np.uint64(TaskContext.get().partitionId()) << np.uint64(40), 0
        for rows in batches:
            for part in slices(rows, "text"):
                texts = texts_of(part.column("text"))
                w = words_of(texts)
                flat = v.value.symbols(texts.raw, w)[0].astype(np.uint16).tobytes()
                ends = 2 * np.cumsum(w.count + 1)
                own = part.column("hash").to_numpy().view(np.uint64)
                again = np.ones(len(own), bool)
                again[np.unique(own, return_index=True)[1]] = False
                place = np.where(again, task + np.arange(number, number + len(own), dtype=np.uint64), 0).astype(np.uint64)
                number += len(own)
                to = mixed(own ^ mixed(place)) % np.uint64(ROUNDS * blocks)
                data = [flat[a:b] for a, b in zip((ends - 2 * (w.count + 1)).tolist(), ends.tolist())]
                yield batch(SYMBOLS, (to % np.uint64(ROUNDS)).astype(np.int64), (to // np.uint64(ROUNDS)).astype(np.int64), own.view(np.int64), data)

    return written(learning.select("text", "hash").mapInArrow(symbols, SYMBOLS))


def trained(learning: DataFrame, like: dict[str, np.ndarray], blocks: int) -> dict[str, np.ndarray]:
    """Weights after all rounds over the documents' symbols; ``learning`` is what :func:`dealt` gives."""
    context = learning.sparkSession.sparkContext
    p = like
    for number in range(ROUNDS):
        held = context.broadcast(p)

        def fit(batches, held=held, number=number):
            """Copies of the blocks of this task, which come one after another; at most ``BLOCK_WORDS`` and a text are held."""
            own, block, seen, waiting, size = None, None, 0, [], 0

            def learn():
                train(own, np.concatenate(waiting).astype(np.int64), RATE / (1 + number))
                waiting.clear()

            for rows in batches:
                of, data = rows.column("block").to_pylist(), rows.column("symbols")
                for b, text in zip(of, data):
                    if b != block:
                        if seen:
                            learn() if waiting else None
                            yield batch(WEIGHTS, [block], [seen], [packed_weights(own)])
                        own, block, seen, size = {k: w.copy() for k, w in held.value.items()}, b, 0, 0
                    waiting.append(np.frombuffer(text.as_buffer(), np.uint16))
                    seen, size = seen + len(waiting[-1]), size + len(waiting[-1])
                    if size > 2 * BLOCK_WORDS:
                        learn()
                        size = 0
            if seen:
                learn() if waiting else None
                yield batch(WEIGHTS, [block], [seen], [packed_weights(own)])

        now = learning.where(F.col("round") == number).select("block", "hash", "symbols")
        now = now.repartition(blocks, "block").sortWithinPartitions("block", "hash", "symbols")
        weights = written(now.mapInArrow(fit, WEIGHTS))
        while weights.count() > FAN_IN:
            group = F.floor(F.col("part") / FAN_IN).alias("group")
            weights = written(weights.withColumn("group", group).groupBy("group").applyInArrow(lambda t: _averaged(t.drop_columns("group")), WEIGHTS))
        rows = weights.toArrow()  # at most FAN_IN rows
        if rows.num_rows:
            p = unpacked_weights(_averaged(rows).column("data")[0].as_py(), like)
    return p


def scored(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows not held out, by default those whose CRC-32 remainder of doc_id modulo 5 is not 1. A null or blank
    text has the end token only. Repeated rows, and rows of equal or null id, are scored each; an empty
    table gives no rows, and where nothing is left to learn from all words are unknown. Words are told
    apart by 64-bit hashes. Only doc_id and text are read.
    """
    context = docs.sparkSession.sparkContext
    held = crc_part(F.col("doc_id"), 5) == 1 if held_out is None else held_out
    docs = docs.select("doc_id", held.alias("held"), "text")
    learning = docs.where("NOT held")
    counts = written(learning.select("text").mapInArrow(_counts, COUNT).groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c")))
    vocabulary = Vocabulary(counts, learning.count())
    v = context.broadcast(vocabulary)
    blocks = max(1, round(vocabulary.words / (ROUNDS * BLOCK_WORDS)))
    symbols = dealt(learning.select("text", F.xxhash64("doc_id", "text").alias("hash")), v, blocks)
    weights = context.broadcast(trained(symbols, start_weights(vocabulary), blocks))

    def score(batches):
        vocabulary, scorer = v.value, Scorer(weights.value)
        task, number = TaskContext.get().partitionId() << 40, 0
        pending: list[tuple] = []

        def flush():
            """The network reads many texts side by side, so several slices wait for it."""
            symbols, count = (np.concatenate(x) for x in list(zip(*pending))[:2])
            logs, out, at = scorer.score(symbols, count), [], 0
            for _, n, row in pending:
                out.append(row(logs[at : at + len(n)]))
                at += len(n)
            pending.clear()
            return out

        for rows in batches:
            for part in slices(rows, "text"):
                texts = texts_of(part.column("text"))
                w = words_of(texts)
                symbols, at, place = vocabulary.symbols(texts.raw, w)
                doc = np.repeat(np.arange(texts.rows), w.count)
                ids = task + number + np.arange(texts.rows)
                number += texts.rows
                frequent = at >= 0
                log_c = np.zeros(len(at))
                log_c[frequent] = np.log10(vocabulary.c[at[frequent]] + 0.5)
                base = np.bincount(doc, log_c, texts.rows) + math.log10(vocabulary.documents + 0.5)
                tail = place == 0
                bucket = symbols[symbols >= CLASS * CLASSES] - CLASS * CLASSES
                rest = np.bincount(doc[tail], log_c[tail] - vocabulary.tail_log[bucket], texts.rows)
                known = np.bincount(doc[frequent], minlength=texts.rows) + (vocabulary.documents > 0)
                other = np.flatnonzero(~frequent)
                if len(other):  # words whose counts are not at hand, once for each text
                    key = np.lexsort((w.hashed[other], doc[other]))
                    d, h = doc[other][key], w.hashed[other][key]
                    heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
                    times = np.diff(np.append(heads, len(h)))
                    k, none = len(heads), pa.nulls
                    yield batch(
                        PART, np.ones(k, np.int32), ids[d[heads]], none(k, pa.int64()), none(k, pa.bool_()), h[heads].view(np.int64), times,
                        none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64()),
                    )

                def row(logs, part=part, ids=ids, n=w.count + 1, known=known, base=base, rest=rest):
                    return batch(
                        PART, np.zeros(len(ids), np.int32), ids, part.column("doc_id"), part.column("held"), pa.nulls(len(ids), pa.int64()), n,
                        known, base, logs + rest,
                    )

                pending.append((symbols, w.count + 1, row))
                if sum(len(s) for s, *_ in pending) > 2_000_000:
                    yield from flush()
        if pending:
            yield from flush()

    parts = written(docs.mapInArrow(score, PART))
    rare = counts.where(vocabulary.bins < vocabulary.floor) if vocabulary.floor is not None else counts
    others = parts.where("kind = 1").select("uid", "h", "n").join(rare.select("h", "c"), "h", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    sums = others.groupBy("uid").agg(F.sum(F.col("n") * log_c).alias("_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_known"))
    out = parts.where("kind = 0").join(sums, "uid", "left")
    log = F.coalesce("_log", F.lit(0.0))
    return out.select(
        "doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.words).cast("long").alias("train_tokens"), (F.col("base") + log - F.col("n") * F.lit(vocabulary.all_log)).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
