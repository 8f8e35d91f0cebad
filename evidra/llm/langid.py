"""Language of a text by a bidirectional gated recurrent network over its bytes (operator 1).

A text's UTF-8 bytes are cut into windows of about ``WINDOW`` bytes of equal size. One network reads a
window forwards, one backwards, and both states at a position give that position's probabilities of all
languages. A document's probabilities are the mean over all positions of the whole text. The networks are
trained in numpy, by backpropagation through time, on a bounded sample: up to ``PER_LANGUAGE`` stretches
of ``STRETCH`` characters for each label, ``STRETCHES`` in all. Every label is a language; more than
``MOST_LABELS`` are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidra.llm import gru
from evidra.llm.common import batch, crc_part
from evidra.llm.textcols import slices, texts_of

UNITS = 8
WINDOW = 256
LANES = 1024
PER_LANGUAGE, STRETCH, STRETCHES, MOST_LABELS = 1000, 512, 64_000, 1000
#: Training steps and memory are set for so many languages; more take more steps and narrower strips.
USUAL = 64
TRAIN_WINDOW, TRAIN_LANES, TRAIN_STEPS, RATE = 64, 128, 500, 0.02
UNKNOWN = "und"
#: The pipeline drops documents whose best language has less than this pooled probability.
LEAST_SCORE = 0.4
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, stretch of text) of labelled rows, a bounded number for each language and in all."""
    labelled = docs.where("lang is not null AND text is not null AND text <> ''")
    labels = labelled.select("lang").distinct().limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} language labels")
    most = min(PER_LANGUAGE, STRETCHES // max(labels, 1))
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - STRETCH, F.lit(1))) + 1
    stretch = F.substring("text", at.cast("int"), F.lit(STRETCH)).alias("stretch")
    order = Window.partitionBy("lang").orderBy("_h", "stretch")
    picked = labelled.select("lang", F.xxhash64("doc_id", "text").alias("_h"), stretch)
    rows = picked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).orderBy("lang", "_r")
    return [(r.lang, r.stretch) for r in rows.select("lang", "stretch").collect()]


class Model:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ways = [gru.start(rng, 256, UNITS), gru.start(rng, 256, UNITS)]
        self.out = {"w": rng.normal(0, 0.1, (2 * UNITS, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def train(self, rows: list[tuple[str, str]], seed: int = 0) -> None:
        """Every position of every window is labelled with its text's language."""
        rng = np.random.default_rng(seed)
        texts = [(self.languages.index(lang), np.frombuffer(t.encode(), np.uint8)) for lang, t in rows]
        texts = [x for x in texts if len(x[1])]
        by = [[x for x in texts if x[0] == k] for k in range(len(self.languages))]
        by = [x for x in by if x]
        if len(by) < 2:
            return
        names = {**{f"{k}{i}": v for i, way in enumerate(self.ways) for k, v in way.items()}, **self.out}
        adam = gru.Adam(names, RATE)
        steps = TRAIN_STEPS * max(USUAL, len(by)) // USUAL
        for done in range(steps):
            window = np.zeros((TRAIN_WINDOW, TRAIN_LANES), np.uint8)
            target = np.zeros(TRAIN_LANES, np.int64)
            mask = np.zeros((TRAIN_WINDOW, TRAIN_LANES), np.float32)
            for lane in range(TRAIN_LANES):
                own = by[rng.integers(len(by))]
                target[lane], data = own[rng.integers(len(own))]
                at = rng.integers(max(1, len(data) - TRAIN_WINDOW + 1))
                part = data[at : at + TRAIN_WINDOW]
                window[: len(part), lane], mask[: len(part), lane] = part, 1
            zero = np.zeros((TRAIN_LANES, UNITS), np.float32)
            flipped = window[::-1]  # padding comes first here; its states carry no loss
            ahead, kept_a = gru.run(self.ways[0], window, zero)
            behind, kept_b = gru.run(self.ways[1], flipped, zero)
            both = np.concatenate([ahead, behind[::-1]], 2)
            d = np.exp(gru.log_softmax(both @ self.out["w"] + self.out["b"]))
            d[:, np.arange(TRAIN_LANES), target] -= 1
            d *= (mask / mask.sum())[:, :, None]
            flat = d.reshape(-1, d.shape[-1])
            grads = {"w": both.reshape(-1, 2 * UNITS).T @ flat, "b": flat.sum(0)}
            d_both = d @ self.out["w"].T
            for i, g in enumerate((gru.back(self.ways[0], window, kept_a, d_both[:, :, :UNITS]), gru.back(self.ways[1], flipped, kept_b, d_both[::-1, :, UNITS:]))):
                grads |= {f"{k}{i}": v for k, v in g.items()}
            adam.update(grads, RATE * 0.05 ** (done / steps))

    def pooled(self, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Mean probabilities over all positions of each text; a text without bytes has zeros."""
        size = np.diff(start)
        pieces = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), pieces)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = start[doc] + size[doc] * k // np.maximum(pieces[doc], 1)
        length = start[doc] + size[doc] * (k + 1) // np.maximum(pieces[doc], 1) - begin
        sums = np.zeros((len(size), len(self.languages)))
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            np.add.at(sums, doc[lanes], self._window_sums(raw, begin[lanes], length[lanes]))
        return sums / np.maximum(size, 1)[:, None]

    def _window_sums(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities; windows are sorted by length, longest first."""
        steps, lanes = int(length[0]), len(begin)
        running = np.searchsorted(-length, -np.arange(steps), "left")  # windows longer than t
        states = np.zeros((2 * UNITS, steps, lanes), np.float32)
        for way, p in enumerate(self.ways):
            reader, h = gru.Reader(p), np.zeros((UNITS, lanes), np.float32)
            edge = begin if way == 0 else begin + length - 1
            for t in range(steps):
                n = int(running[t])
                if n < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :n])
                h = reader.step(raw.take(edge[:n] + t if way == 0 else edge[:n] - t), h)
                if way == 0:
                    states[:UNITS, t, :n] = h
                elif length[n - 1] == steps:
                    states[UNITS:, steps - 1 - t, :n] = h
                else:
                    states[UNITS:, length[:n] - 1 - t, np.arange(n)] = h
        out = np.zeros((len(self.languages), lanes))
        w, bias = np.ascontiguousarray(self.out["w"].T), self.out["b"][:, None]
        strip = max(1, 32 * USUAL // max(USUAL, len(self.languages)))
        for t in range(0, steps, strip):
            part = np.ascontiguousarray(states[:, t : t + strip])
            x = w @ part.reshape(2 * UNITS, -1)  # one row per language
            x += bias
            x -= x.max(0)
            np.exp(x, out=x)
            x /= x.sum(0)
            inside = np.arange(t, t + part.shape[1])[:, None] < length[None, :]
            out += (x.reshape(len(x), *inside.shape) * inside).sum(1)
        return out.T


def trained(docs: DataFrame) -> Model:
    """A model of the labelled rows of ``docs``, from their text and lang alone."""
    rows = sample(docs)
    model = Model(sorted({lang for lang, _ in rows}))
    model.train(rows)
    return model


def _labelled(model: Model, rows):
    """(language, score) of a batch with columns text and _letters."""
    best, score = [], []
    for part in slices(rows, "text"):
        texts = texts_of(part.column("text"))
        if not model.languages or not len(texts.raw):
            best += [UNKNOWN] * texts.rows
            score += [0.0] * texts.rows
            continue
        p = model.pooled(texts.raw, texts.start)
        top = p.argmax(1)
        letters = part.column("_letters").to_numpy(zero_copy_only=False)
        best += [model.languages[k] if has else UNKNOWN for k, has in zip(top.tolist(), letters.tolist())]
        score += np.where(letters, np.clip(p.max(1), 0, 1), 0.0).tolist()
    return best, score


def _letters() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letters")


def languages(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learning from the rows not held out.

    ``held_out`` is by default a CRC-32 remainder of doc_id. lang_pred is ``und`` with score 0 where the
    text is null or has no letter, or where no row is labelled. With one language in the labels that is
    the answer for all texts with letters. Repeated rows and null ids are rows like any other; an empty
    table gives no rows. Only doc_id, text and, for learning, lang are read.
    """
    held = crc_part(F.col("doc_id"), 3) == 1 if held_out is None else held_out
    model = docs.sparkSession.sparkContext.broadcast(trained(docs.where(~held)))  # a few thousand numbers

    def label(batches):
        for rows in batches:
            if rows.num_rows:
                yield batch(PREDICTED, rows.column("doc_id"), rows.column("_held"), *_labelled(model.value, rows))

    return docs.select("doc_id", held.alias("_held"), "text", _letters()).mapInArrow(label, PREDICTED)


def language_kept(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has letters and a language of at least ``least`` pooled probability, as they are.

    The model learns from all labelled rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = docs.select(row, "text", _letters())

    def keep(batches):
        for rows in batches:
            if rows.num_rows:
                best, score = _labelled(model.value, rows)
                fine = np.array([b != UNKNOWN for b in best]) & (np.array(score) >= least)
                yield rows.select(["_row"]).filter(pa.array(fine))

    return marked.mapInArrow(keep, marked.select("_row").schema).select("_row.*")
