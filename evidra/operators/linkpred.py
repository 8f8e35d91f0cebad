"""Translation-embedding link prediction.

Vectors are ``(id, vec ARRAY<DOUBLE>)`` tables. Training is full-batch gradient descent as
joins and sums. Top-k search is exact: entities are grouped around a bounded set of pivots,
and the triangle inequality tells which groups can hold one of a query's k nearest. Groups
are cut into packed blocks that pass by a bounded group of queries one after the other, and
only a query's best k so far are kept, so a task's memory does not depend on the tables.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidra import vocab
from evidra.operators.first_epoch import SUMS, FirstEpoch
from evidra.operators.ranking import global_row_number
from evidra.operators.relational import SPO, triples
from evidra.operators.skew import BROADCAST_ROWS, checked_lookup, frequent_keys, hot_keys, lookup_with, salted_lookup, salted_lookups
from evidra.session import cut_lineage

# Task-side helpers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PIVOTS = 256
BLOCK = 2_048
#: Queries that a task holds while all blocks pass by, and of these, those that meet a block at once.
QUERIES = 32_768
CHUNK = 1_024
#: Edges of an entity from which its number or vector is sent to them, instead of they to it.
HOT_EDGES = 50_000


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """(column, idx): 0-based position in sorted order of the distinct values."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return global_row_number(distinct, [F.asc(column)], "idx").withColumn("idx", F.col("idx") - 1)


def entity_ids(relations: DataFrame) -> DataFrame:
    """Dense ids of everything that is an end of an edge."""
    return dense_ids(relations.select(F.explode(F.array("subject", "object")).alias("entity")), "entity")


def encode_triples(relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity ids, predicate ids, encoded edges h, r, t) of the edge bag, which is written and read back first.

    Objects come first: those of many edges are looked up without a shuffle.
    """
    relations = cut_lineage(relations.select(*SPO))
    entities = cut_lineage(entity_ids(relations))
    predicates = dense_ids(relations, "predicate")
    h = entities.select(F.col("entity").alias("subject"), F.col("idx").alias("h"))
    t = entities.select(F.col("entity").alias("object"), F.col("idx").alias("t"))
    ends = relations
    for lookup, key, hot in zip((t, h), ("object", "subject"), frequent_keys(relations, ("object", "subject"), HOT_EDGES)):
        ends = lookup_with(ends, lookup, key, "inner", hot, apart=True)
    encoded = checked_lookup(ends, predicates.select("predicate", F.col("idx").alias("r")), "predicate")
    return entities, predicates, encoded.select("h", "r", "t")


def initial_vectors(ids: DataFrame, dim: int, seed: int = 42, scale: float = 0.1) -> DataFrame:
    """Normal vectors drawn from hashes of (id, position), so a retried task draws the same."""
    def uniform(k: Column, salt: int) -> Column:
        h = F.pmod(F.xxhash64("id", k, F.lit(seed + salt)), F.lit(2**53))
        return (h + 0.5) / float(2**53)

    def normal(k: Column) -> Column:
        return F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * np.pi * uniform(k, 1)) * scale

    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal).alias("vec"))


def digit_vectors(ids: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """Vectors between -1 and 1 from the md5 digits of "seed:id:position", the same in any engine."""
    def digit(k: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), k.cast("string"))
        return _digits(text) / F.lit(float(2**31)) - 1

    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), digit).alias("vec"))


def _digits(text: Column) -> Column:
    """The first 32 bits of a text's md5 as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def normalised(vectors: DataFrame) -> DataFrame:
    """Unit vectors; a zero vector stays as it is."""
    length = norm(F.col("vec"))
    return vectors.withColumn(
        "vec", F.transform("vec", lambda x: x / F.when(length > 0, length).otherwise(F.lit(1.0)))
    )


def _sum_vectors(column: str, dim: int) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(dim)])


def train_transe(
    edges: DataFrame, dim: int = 64, epochs: int = 100, learning_rate: float = 0.01, seed: int = 42, initial=initial_vectors,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """(entity vectors, relation vectors, mean loss per epoch) of ``edges(h, r, t)``.

    Loss is the mean of |h + r - t|^2 without negative samples. A vector moves by the mean of
    its edges' gradients times the rate, so hubs do not overshoot; the residual sums combine
    map-side. Vectors are checkpointed every epoch but the last, whose step is taken when they are read.
    """
    edges = cut_lineage(edges.select("h", "r", "t"))
    ids = edges.select(F.explode(F.array("h", "t")).alias("id")).distinct()
    entities = cut_lineage(normalised(initial(ids, dim, seed)))
    relations = cut_lineage(initial(edges.select(F.col("r").alias("id")).distinct(), dim, seed + 1))
    # Edges do not change, so their hot keys are found once for all epochs.
    hot = dict(zip("ht", frequent_keys(edges, ("h", "t"), HOT_EDGES)))
    few_relations = relations.count() <= BROADCAST_ROWS
    hot_r = None if few_relations else hot_keys(edges, "r")
    losses: list[float] = []
    for _ in range(epochs):
        residual = F.zip_with(
            F.zip_with("hv", "rv", lambda a, b: a + b), "tv", lambda a, b: a - b
        )
        named = lambda table, end: table.select(F.col("id").alias(end), F.col("vec").alias(f"{end}v"))
        scored = lookup_with(edges, named(entities, "h"), "h", "inner", hot["h"], apart=True)
        scored = lookup_with(scored, named(entities, "t"), "t", "inner", hot["t"], apart=True)
        by_relation = named(relations, "r")
        scored = lookup_with(scored, F.broadcast(by_relation) if few_relations else by_relation, "r", "inner", hot_r)
        scored = scored.select("h", "r", "t", residual.alias("e"))
        minus = lambda c: F.transform(c, lambda x: -x)
        square = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
        moves = scored.select(F.inline(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("h").alias("id"), F.col("e").alias("g")),
            F.struct(F.lit(0).alias("kind"), F.col("t").alias("id"), minus("e").alias("g")),
            F.struct(F.lit(1).alias("kind"), F.col("r").alias("id"), F.col("e").alias("g")),
        )))
        summed = moves.groupBy("kind", "id").agg(
            _sum_vectors("g", dim).alias("g"), F.count("*").alias("n"),
            F.sum(F.when(F.col("kind") == 1, F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x))).alias("loss"),
        )
        last = len(losses) == epochs - 1
        if last:
            # No gradient travels for the loss alone.
            losses.append(scored.agg(F.avg(square)).first()[0])
        else:
            summed = cut_lineage(summed)
            total = summed.where("kind = 1").agg(F.sum("loss"), F.sum("n")).first()
            losses.append(total[0] / total[1])
        # d|e|^2 = 2e on the head and the relation, -2e on the tail.
        step = F.zip_with("vec", "g", lambda v, g: v - 2 * learning_rate * g / F.col("n"))
        moved = lambda table, kind: table.join(
            summed.where(F.col("kind") == kind).select("id", "g", "n"), "id"
        ).select("id", step.alias("vec"))
        entities, relations = normalised(moved(entities, 0)), moved(relations, 1)
        if not last:
            entities, relations = cut_lineage(entities), cut_lineage(relations)
    return entities, relations, losses


def corrupted(edges: DataFrame, entities: int, epoch: int) -> DataFrame:
    """``edges(h, r, t)`` with a wrong tail ``c``, drawn anew each epoch by the md5 of the edge and the epoch.

    Entity ids are 0 to ``entities`` - 1; every other entity than t is as likely.
    """
    drawn = _digits(F.concat_ws(":", F.col("h").cast("string"), F.col("r").cast("string"), F.col("t").cast("string"), F.lit(str(epoch))))
    return edges.withColumn("c", F.pmod(F.col("t") + 1 + drawn % (entities - 1), F.lit(entities)))


def train_margin(
    edges: DataFrame, entities: int, dim: int = 64, epochs: int = 100, learning_rate: float = 0.01, margin: float = 1.0, seed: int = 42,
    initial=digit_vectors,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity vectors, relation vectors, (epoch, loss)) of ``edges(h, r, t)`` by ranking loss against wrong tails.

    The loss of an edge is max(0, margin + |h + r - t|^2 - |h + r - c|^2) with one wrong tail c of ``corrupted``.
    A vector moves by the mean over the active edges it is part of. Ids run from 0 to ``entities`` - 1, at least two; an
    entity without edges is learned as a wrong tail.

    ``digit_vectors`` follow from ids, so the first of several epochs sends ids and no vectors (``first_epoch``), unless there are
    very many relations. Other epochs look vectors up. Equal edges are one row with a weight then; wrong tails are spread
    evenly over all entities, so their lookup has no hot key; those of heads and tails are found once. Gradient sums combine
    map-side, and the loss is one more group of that sum, so no epoch waits for a number on the driver. Vectors are
    checkpointed every epoch but the last, whose loss and step are computed when they are read.
    """
    if entities < 2:
        raise ValueError("a wrong tail needs a second entity")
    spark = edges.sparkSession
    edges = cut_lineage(edges.select(*[F.col(c).cast("long") for c in "hrt"]).dropna())
    relations = cut_lineage(initial(edges.select(F.col("r").alias("id")).distinct(), dim, seed + 1))
    hot = dict(zip("ht", frequent_keys(edges, ("h", "t"), HOT_EDGES)))
    few_relations = relations.count() * dim <= BROADCAST_ROWS
    hot_r = None if few_relations else hot_keys(edges, "r")
    weighted = edges.groupBy("h", "r", "t").agg(F.count("*").alias("w"))
    losses: list[DataFrame] = []
    second = None
    if epochs > 1 and few_relations and initial is digit_vectors:
        known = sorted({row[0] for found in hot.values() if found is not None for row in found.collect()})  # few, see frequent_keys
        first = FirstEpoch(
            entities, dim, learning_rate, margin, seed, known, [row["id"] for row in relations.select("id").collect()], spark.sparkContext.defaultParallelism)
        summed = cut_lineage(edges.mapInArrow(first.sums, SUMS).groupBy("kind", "id").agg(
            _sum_vectors("g", dim).alias("g"), F.sum("n").alias("n"), F.sum("loss").alias("loss")))
        losses.append(_mean_loss(summed.where("kind = 2"), 1))
        relations = cut_lineage(_moved(relations, summed, 1, learning_rate))
        first.know(summed.where("kind = 0").select("id", "g", "n").collect(), relations.collect())
        vectors, second = first.steps(edges)
        if epochs > 2:
            vectors = cut_lineage(vectors)
    else:
        vectors = cut_lineage(normalised(initial(spark.range(entities), dim, seed)))
    if epochs > len(losses) + 1:
        weighted = cut_lineage(weighted)
    none = F.array(*[F.lit(0.0)] * dim)
    for epoch in range(len(losses) + 1, epochs + 1):
        named = lambda table, end: table.select(F.col("id").alias(end), F.col("vec").alias(f"{end}v"))
        rows = lookup_with(corrupted(weighted, entities, epoch), named(vectors, "h"), "h", "inner", hot["h"], apart=True)
        rows = lookup_with(rows, named(vectors, "t"), "t", "inner", hot["t"], apart=True)
        by_relation = named(relations, "r")
        rows = lookup_with(rows, F.broadcast(by_relation) if few_relations else by_relation, "r", "inner", hot_r)
        rows = rows.join(named(vectors, "c"), "c")
        sums = F.zip_with("hv", "rv", lambda a, b: a + b)
        rows = rows.select("h", "r", "t", "c", "w", F.zip_with(sums, "tv", lambda a, b: a - b).alias("e"), F.zip_with(sums, "cv", lambda a, b: a - b).alias("f"))
        square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
        rows = rows.withColumn("hinge", F.greatest(F.lit(0.0), margin + square("e") - square("f")))
        both = F.zip_with("e", "f", lambda a, b: a - b)

        def part(kind: int, id_: str | Column, g: Column, n: Column, loss: Column) -> Column:
            id_ = F.col(id_) if isinstance(id_, str) else id_
            return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), g.alias("g"), n.alias("n"), loss.alias("loss"))

        weighed = lambda v, k: F.transform(v, lambda x: x * (k * F.col("w")))
        zero = F.lit(0.0)
        active = F.when(F.col("hinge") > 0, F.array(
            part(0, "h", weighed(both, 2), F.col("w"), zero), part(0, "t", weighed("e", -2), F.col("w"), zero),
            part(0, "c", weighed("f", 2), F.col("w"), zero), part(1, "r", weighed(both, 2), F.col("w"), zero),
        )).otherwise(F.array().cast("array<struct<kind:int,id:bigint,g:array<double>,n:bigint,loss:double>>"))
        loss_row = F.array(part(2, F.lit(0).cast("long"), none, F.col("w"), F.col("hinge") * F.col("w")))
        summed = rows.select(F.inline(F.concat(active, loss_row))).groupBy("kind", "id").agg(
            _sum_vectors("g", dim).alias("g"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
        if epoch < epochs:
            summed = cut_lineage(summed)
            total = summed.where("kind = 2")
        elif epoch == 2 and second is not None:
            total = second.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
        else:
            # No gradient travels for the loss alone.
            total = rows.agg(F.sum(F.col("hinge") * F.col("w")).alias("loss"), F.sum("w").alias("n"))
        losses.append(_mean_loss(total, epoch))
        vectors, relations = normalised(_moved(vectors, summed, 0, learning_rate)), _moved(relations, summed, 1, learning_rate)
        if epoch < epochs:
            vectors, relations = cut_lineage(vectors), cut_lineage(relations)
    return vectors, relations, reduce(DataFrame.unionByName, losses)


def _mean_loss(total: DataFrame, epoch: int) -> DataFrame:
    return total.where("n > 0").select(F.lit(epoch).alias("epoch"), (F.col("loss") / F.col("n")).alias("loss"))


def _moved(table: DataFrame, summed: DataFrame, kind: int, rate: float) -> DataFrame:
    """Vectors after a step by the mean of their gradients (kind, id, g, n); without any they stay."""
    step = F.when(F.col("g").isNotNull(), F.zip_with("vec", "g", lambda v, g: v - rate * g / F.col("n"))).otherwise(F.col("vec"))
    return table.join(summed.where(F.col("kind") == kind).select("id", "g", "n"), "id", "left").select("id", step.alias("vec"))


def score_triples(candidates: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """-|h + r - t| per (subject, predicate, object); -inf where an id has no vector."""
    h = entities.select(F.col("id").alias("subject"), F.col("vec").alias("_h"))
    t = entities.select(F.col("id").alias("object"), F.col("vec").alias("_t"))
    r = relations.select(F.col("id").alias("predicate"), F.col("vec").alias("_r"))
    joined = checked_lookup(salted_lookups(candidates, [(h, "subject"), (t, "object")]), r, "predicate", "left")
    e = F.zip_with(F.zip_with("_h", "_r", lambda a, b: a + b), "_t", lambda a, b: a - b)
    return joined.withColumn("score", F.coalesce(-norm(e), F.lit(float("-inf")))).drop("_h", "_r", "_t")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _to_pivots(pivots: np.ndarray):
    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), pivots)
                pdf = pdf.assign(pivot=d.argmin(1).astype("int32"), distance=d.min(1))
                yield pdf[["id", "vec", "pivot", "distance"]]

    return assign


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed_entities(need: int):
    """One row per block: its ids and vectors. Of equal vectors, only the ``need`` first ids can be among the nearest."""
    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        vecs = _vectors(block["vec"])
        _, same = np.unique(vecs, axis=0, return_inverse=True)
        same = same.ravel()
        order = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.diff(same[order], prepend=-1))
        copy = np.empty(len(same), dtype=int)
        copy[order] = np.arange(len(same)) - np.repeat(starts, np.diff(starts, append=len(same)))
        keep = np.flatnonzero(copy < need)
        return pa.table({
            "pivot": block["pivot"][:1], "radius": [float(block["distance"].to_numpy().max())],
            "ids": pa.array([block["id"].combine_chunks().take(pa.array(keep))], pa.list_(pa.string())), "vecs": [vecs[keep].tobytes()],
        })

    return pack


def _packed_queries():
    """Each batch's queries by group, one row per group."""
    def pack(batches):
        for batch in batches:
            grp, vecs = batch["grp"].to_numpy(), _vectors(batch["vec"])
            found = [(g, np.flatnonzero(grp == g)) for g in np.unique(grp)]
            lists = lambda name: pa.array([batch[name].take(pa.array(rows)) for _, rows in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.int32()), lists("qid"), lists("skip"), pa.array([vecs[rows].tobytes() for _, rows in found], pa.binary())],
                ["grp", "ids", "skips", "vecs"])

    return pack


class _Nearest:
    """The k nearest entities of a group of queries, while blocks of entities pass by."""

    def __init__(self, k: int, centres: np.ndarray, closest: list[np.ndarray]):
        self.k, self.centres, self.closest = k, centres, closest
        self.parts, self.ready = [], False

    def add(self, qid: pa.Array, skip: pa.Array, vecs: np.ndarray) -> None:
        self.parts.append((qid, skip.to_numpy(zero_copy_only=False), vecs))

    def _start(self) -> None:
        self.ready = True
        self.qid = pa.concat_arrays([p[0] for p in self.parts])
        self.skip = np.concatenate([p[1] for p in self.parts])
        self.q = np.concatenate([p[2] for p in self.parts])
        self.parts = []
        n = len(self.q)
        self.q2 = (self.q * self.q).sum(1)
        self.rough = np.concatenate([self.q, np.full((n, 1), -1.0)], axis=1).astype(np.float32)
        self.far = np.full((n, self.k), np.inf)
        self.who = np.full((n, self.k), "", dtype=object)
        # |q - p| + |p - e| bounds the distance of entity e from above; one extra for the skipped entity.
        self.worst = np.full(n, np.inf)
        if sum(len(c) for c in self.closest) > self.k:
            for at in range(0, n, CHUNK):
                d = _distances(self.q[at : at + CHUNK], self.centres)
                upper = np.concatenate([d[:, [p]] + c[None, :] for p, c in enumerate(self.closest) if len(c)], axis=1)
                self.worst[at : at + CHUNK] = np.partition(upper, self.k, axis=1)[:, self.k] * (1 + 1e-9) + 1e-9

    def meet(self, ids: np.ndarray, e: np.ndarray, centre: np.ndarray, radius: float) -> None:
        if not self.ready:
            self._start()
        far = np.sqrt(((self.q - centre) ** 2).sum(1)) - radius
        rows = np.flatnonzero(far <= self.worst * (1 + 1e-9) + 1e-9)
        half = (e * e).sum(1)[:, None] / 2
        longest = float(np.sqrt(2 * half.max()))
        single = np.concatenate([e, half], axis=1).astype(np.float32).T if longest < 1e15 else None
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            for r, c in self._close(part, e, half, single, longest):
                for cut in range(0, len(r), 1 << 16):
                    self._keep(part[r[cut : cut + (1 << 16)]], c[cut : cut + (1 << 16)], ids, e)

    def _close(self, part: np.ndarray, e: np.ndarray, half: np.ndarray, single: np.ndarray | None, longest: float):
        """Pairs that may be among the nearest: q.e - |e|^2 / 2 in single precision, within its error, then in double."""
        size = np.sqrt(self.q2[part]) + longest
        least = (self.q2[part] - self.worst[part] ** 2 * (1 + 1e-9)) / 2
        for double in (False, True):
            if not double and (single is None or size.max() > 1e15 or size.min() < 1e-12):
                continue
            error = (e.shape[1] + 16) * np.finfo(np.float64 if double else np.float32).eps * size**2
            near = self.q[part] @ e.T - half.T if double else self.rough[part] @ single
            floor = (least - error).astype(near.dtype)[:, None]
            hit = near >= floor
            if np.count_nonzero(hit) > 4 * (self.k + 1) * len(part) and len(e) > self.k + 1:
                # The block's own k-th nearest, and one for the skipped entity, bounds better.
                own = np.partition(near, len(e) - self.k - 1, axis=1)[:, len(e) - self.k - 1]
                hit = near >= np.maximum(least - error, own - 2 * error).astype(near.dtype)[:, None]
                if not double and np.count_nonzero(hit) > 64 * (self.k + 1) * len(part):
                    continue
            yield np.nonzero(hit)
            return

    def _keep(self, r: np.ndarray, c: np.ndarray, ids: np.ndarray, e: np.ndarray) -> None:
        d = np.sqrt(((e[c] - self.q[r]) ** 2).sum(1))
        ok = (d <= self.worst[r]) & (ids[c] != self.skip[r])
        r, c, d = r[ok], c[ok], d[ok]
        if not len(r):
            return
        some, at = np.unique(r, return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(some)), self.k)])
        d = np.concatenate([d, self.far[some].ravel()])
        who = np.concatenate([ids[c], self.who[some].ravel()])
        order = np.lexsort((who, d, at))
        at, d, who = at[order], d[order], who[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        self.far[some[at[first]], place[first]] = d[first]
        self.who[some[at[first]], place[first]] = who[first]
        self.worst[some] = np.minimum(self.worst[some], self.far[some, -1])

    def results(self):
        for at in range(0, len(self.q) if self.ready else 0, 8_192):
            far, who = self.far[at : at + 8_192], self.who[at : at + 8_192]
            rows, cols = np.nonzero(np.isfinite(far))
            yield pa.RecordBatch.from_arrays(
                [self.qid.take(pa.array(rows + at)), pa.array(who[rows, cols], pa.string()), pa.array(far[rows, cols]), pa.array(cols + 1, pa.int32())],
                ["qid", "id", "distance", "rank"])


def _passing(k: int, centres: np.ndarray, closest: list[np.ndarray]):
    """A group's queries come first, then one block of entities after the other."""
    def search(batches):
        current, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                grp = batch["grp"][i].as_py()
                if grp != current:
                    if state is not None:
                        yield from state.results()
                    current, state = grp, _Nearest(k, centres, closest)
                ids = batch["ids"][i].values
                vecs = np.frombuffer(batch["vecs"][i].as_buffer(), dtype=float).reshape(len(ids), -1)
                if batch["kind"][i].as_py() == 0:
                    state.add(ids, batch["skips"][i].values, vecs)
                elif state.parts or state.ready:
                    state.meet(ids.to_numpy(zero_copy_only=False), vecs, centres[batch["pivot"][i].as_py()], batch["radius"][i].as_py())
        if state is not None:
            yield from state.results()

    return search


def nearest(
    queries: DataFrame, entities: DataFrame, k: int, pivots: int | None = None, block: int = BLOCK
) -> DataFrame:
    """(qid, id, distance, rank): the k nearest entities of each query, exactly.

    ``queries(qid STRING, skip STRING, vec)``: ``skip`` is an entity never returned for it.
    ``entities(id STRING, vec)``. Ties are broken by id. By default there is one pivot per
    block of entities, up to ``MAX_PIVOTS``.
    """
    if pivots is None:
        pivots = min(MAX_PIVOTS, max(1, -(-entities.count() // block)))
    # A bounded sample of entities (by hash order) serves as pivots on the driver.
    sample = entities.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not sample:
        empty = queries.select("qid", F.col("skip").alias("id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        return empty.limit(0)
    centres = np.array([r["vec"] for r in sample], dtype=float)
    assigned = cut_lineage(entities.select("id", "vec").mapInPandas(
        _to_pivots(centres), "id string, vec array<double>, pivot int, distance double"))

    # One extra, because a query's own skipped entity may be among the nearest.
    need = k + 1
    nearest_first = Window.partitionBy("pivot").orderBy("distance", "id")
    # At most pivots x (k + 1) rows come back.
    head = assigned.select("pivot", "distance", "id").withColumn("rn", F.row_number().over(nearest_first))
    closest = [[] for _ in range(len(sample))]
    for row in head.where(F.col("rn") <= need).select("pivot", "distance").collect():
        closest[row["pivot"]].append(row["distance"])
    blocks = {r["pivot"]: max(1, -(-r["n"] // block)) for r in assigned.groupBy("pivot").agg(F.count("*").alias("n")).collect()}

    spark = entities.sparkSession
    queries = cut_lineage(queries.select("qid", "skip", F.col("vec").cast("array<double>").alias("vec")))
    asked, slots = queries.count(), spark.sparkContext.defaultParallelism
    # Every block passes each group once, so groups are as large as a task can hold, or as small as all slots need.
    groups = max(1, min(-(-asked // block), -(-asked // (QUERIES * slots)) * slots))
    part = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    sizes = F.broadcast(spark.createDataFrame(list(blocks.items()), "pivot int, e_blocks int"))  # one row per pivot
    e = cut_lineage(
        assigned.join(sizes, "pivot").withColumn("eb", part("id", F.col("e_blocks"))).groupBy("pivot", "eb")
        .applyInArrow(_packed_entities(need), "pivot int, radius double, ids array<string>, vecs binary"))
    q = queries.withColumn("grp", part("qid", F.lit(groups))).mapInArrow(
        _packed_queries(), "grp int, ids array<string>, skips array<string>, vecs binary").withColumn("kind", F.lit(0))
    e = e.withColumns({"grp": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "kind": F.lit(1)})
    both = q.unionByName(e, allowMissingColumns=True).repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "kind")
    return both.select("grp", "kind", "ids", "skips", "vecs", "pivot", "radius").mapInArrow(
        _passing(k, centres, [np.sort(np.array(c)) for c in closest]), "qid string, id string, distance double, rank int")


def _translated(pairs: DataFrame, entities: DataFrame, relations: DataFrame, end: str, sign: int) -> DataFrame:
    moved = salted_lookup(pairs, entities.select(F.col("id").alias(end), F.col("vec").alias("_v")), end, "inner")
    joined = checked_lookup(moved, relations.select(F.col("id").alias("predicate"), F.col("vec").alias("_r")), "predicate")
    vec = F.zip_with("_v", "_r", lambda a, b: a + sign * b)
    qid = F.to_json(F.struct(F.col(end).alias("e"), F.col("predicate").alias("p")))
    return joined.select(qid.alias("qid"), F.col(end).alias("skip"), vec.alias("vec"))


def _named(found: DataFrame, asked: str, answer: str) -> DataFrame:
    parts = F.from_json("qid", "e string, p string")
    return found.select(
        parts["e"].alias(asked), parts["p"].alias("predicate"), F.col("id").alias(answer),
        (-F.col("distance")).alias("score"), "rank",
    )


def predict_tails(pairs: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """Best objects for ``pairs(subject, predicate)``, never the subject itself."""
    return _named(nearest(_translated(pairs, entities, relations, "subject", 1), entities, k), "subject", "object")


def predict_heads(pairs: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """Best subjects for ``pairs(predicate, object)``, never the object itself."""
    return _named(nearest(_translated(pairs, entities, relations, "object", -1), entities, k), "object", "subject")


def confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def generate_candidates(
    edges: DataFrame, entities: DataFrame, relations: DataFrame, types: DataFrame | None = None,
    predicates: list[str] | None = None, top_k: int = 5, min_score: float = float("-inf"),
) -> DataFrame:
    """Predicted edges of every entity and wanted predicate that the graph lacks.

    The top k are cut before the novelty test. ``types(id, entity_type)`` labels both ends.
    """
    wanted = vocab.LINK_PREDICTION_PREDICATES if predicates is None else predicates
    each = F.explode(F.array(*[F.lit(p) for p in wanted]))
    pairs = entities.select(F.col("id").alias("subject"), each.alias("predicate"))
    found = predict_tails(pairs, entities, relations, top_k).where(F.col("score") >= min_score)
    fresh = found.join(triples(edges), SPO, "left_anti").withColumn("confidence", confidence(F.col("score")))
    if types is not None:
        for end in ("subject", "object"):
            t = types.select(F.col("id").alias(end), F.col("entity_type").alias(f"{end}_type"))
            fresh = fresh.join(t, end, "left").fillna("Unknown", [f"{end}_type"])
    return fresh.withColumns({"source": F.lit("kg_embedding"), "status": F.lit("proposed"), "is_novel": F.lit(True)})
