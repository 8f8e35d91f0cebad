"""Training against wrong tails, next to the same steps in plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bench import shuffled
from evidra.operators import first_epoch as E
from evidra.operators import linkpred as L
from evidra.operators import skew as S


def digits(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def start(seed, id_, dim):
    return np.array([digits(f"{seed}:{id_}:{i}") / 2**31 - 1 for i in range(dim)])


def unit(v):
    return v / (np.linalg.norm(v) or 1.0)


def plain_margin(edges, n, dim, epochs, rate, margin):
    v = {i: unit(start(42, i, dim)) for i in range(n)}
    r = {p: start(43, p, dim) for _, p, _ in edges}
    losses = []
    for epoch in range(1, epochs + 1):
        sums, count, total = defaultdict(lambda: np.zeros(dim)), defaultdict(int), 0.0
        for h, p, t in edges:
            c = (t + 1 + digits(f"{h}:{p}:{t}:{epoch}") % (n - 1)) % n
            assert c != t
            e, f = v[h] + r[p] - v[t], v[h] + r[p] - v[c]
            loss = max(0.0, margin + e @ e - f @ f)
            total += loss
            if loss > 0:
                for key, g in (((0, h), 2 * (e - f)), ((0, t), -2 * e), ((0, c), 2 * f), ((1, p), 2 * (e - f))):
                    sums[key] += g
                    count[key] += 1
        losses.append(total / len(edges))
        step = lambda kind, i, x: x - rate * sums[kind, i] / count[kind, i] if count[kind, i] else x  # noqa: E731, B023
        v, r = {i: unit(step(0, i, x)) for i, x in v.items()}, {p: step(1, p, x) for p, x in r.items()}
    return v, r, losses


@pytest.mark.parametrize("parts", [1, 5])
def test_margin_training_takes_the_plain_steps_under_any_layout(spark, parts):
    rng = np.random.default_rng(3)
    edges = [(int(rng.integers(9)), int(rng.integers(3)), int(rng.integers(9))) for _ in range(60)] + [(0, 0, 1)] * 40
    n = 12  # three entities have no edge
    vectors, relations, losses = L.train_margin(spark.createDataFrame(edges, "h long, r long, t long").repartition(parts), n, dim=4, epochs=3, learning_rate=0.2, margin=0.5)
    v, r, want = plain_margin(edges, n, 4, 3, 0.2, 0.5)
    assert np.allclose([x.loss for x in losses.orderBy("epoch").collect()], want)
    assert want[-1] < want[0]
    for table, plain in ((vectors, v), (relations, r)):
        got = {x.id: x.vec for x in table.collect()}
        assert got.keys() == plain.keys() and all(np.allclose(got[i], plain[i]) for i in got)


def test_wrong_tails_need_a_second_entity(spark):
    with pytest.raises(ValueError):
        L.train_margin(spark.createDataFrame([(0, 0, 0)], "h long, r long, t long"), 1)


def test_hot_ends_are_looked_up_where_their_edges_are(spark, monkeypatch):
    """Objects of many edges get their number by broadcast; edges and numbers stay those of the plain join."""
    monkeypatch.setattr(L, "HOT_EDGES", 50)
    rows = [(f"s{i}", "p", f"o{i % 3}") for i in range(300)] + [("s1", "q", "rare"), ("s1", "q", "rare")]
    edges = spark.createDataFrame(rows, "subject string, predicate string, object string")
    entities, predicates, encoded = L.encode_triples(edges)
    e, p = ({r[0]: r[1] for r in t.collect()} for t in (entities, predicates))
    assert sorted(map(tuple, encoded.collect())) == sorted((e[s], p[q], e[o]) for s, q, o in rows)
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_the_last_step_waits_until_vectors_are_read(spark, monkeypatch):
    edges = spark.createDataFrame([(i, 0, i + 5) for i in range(5)], "h long, r long, t long")
    written, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    L.train_transe(edges, dim=2, epochs=1)
    L.train_margin(edges, 10, dim=2, epochs=1)
    assert ["kind", "id", "g", "n", "loss"] not in written


def test_hashes_of_many_texts_are_those_of_each():
    texts = [f"{i * 7919}:{i}" * (1 + i % 3) for i in range(1000)] + ["", "x" * 55, "y" * 54]
    for more in ([], ["z" * 56, "z" * 130]):
        assert E.md5_digits(pa.array(texts + more)).tolist() == [digits(x) for x in texts + more]
    assert E.md5_digits(pa.array(texts).slice(3, 40)).tolist() == [digits(x) for x in texts[3:43]]


def random_edges(n, seed=5, edges=400):
    rng = np.random.default_rng(seed)
    return [(int(h), int(r), int(t)) for h, r, t in zip(rng.integers(n, size=edges), rng.integers(3, size=edges) * 7, rng.integers(n, size=edges))]


@pytest.mark.parametrize("most, hot", [(40, {3, 8}), (170, {8}), (1000, set())])
def test_first_epoch_by_ids_takes_the_plain_steps_with_and_without_hot_ends(spark, monkeypatch, most, hot):
    """Head 3 and tail 8 have very many edges, some of them equal; entities past 150 have none. Tail 8 is the head of few."""
    monkeypatch.setattr(L, "HOT_EDGES", most)
    edges = random_edges(150) + [(3, 0, i % 90) for i in range(80)] + [(i % 70, 7, 8) for i in range(130)] + [(3, 14, 8)] * 60 + [(8, 0, 20), (8, 7, 3)]
    n = 170
    ends = [Counter(e[i] for e in edges) for i in (0, 2)]
    assert {k for end in ends for k, count in end.items() if count > most} == hot
    vectors, relations, losses = L.train_margin(spark.createDataFrame(edges, "h long, r long, t long").repartition(4), n, dim=4, epochs=2, learning_rate=0.2)
    v, r, want = plain_margin(edges, n, 4, 2, 0.2, 1.0)
    assert np.allclose([x.loss for x in losses.orderBy("epoch").collect()], want)
    for table, plain in ((vectors, v), (relations, r)):
        got = {x.id: x.vec for x in table.collect()}
        assert got.keys() == plain.keys() and all(np.allclose(got[i], plain[i]) for i in got)


def test_edges_without_rows_have_no_loss(spark):
    none = spark.createDataFrame([], "h long, r long, t long")
    vectors, relations, losses = L.train_margin(none, 5, dim=3, epochs=2)
    assert losses.collect() == [] and relations.collect() == [] and vectors.count() == 5


def test_losses_of_two_epochs_send_about_one_vector_an_edge(spark):
    edges = spark.createDataFrame(random_edges(7_000, edges=20_000), "h long, r long, t long").coalesce(1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        before = shuffled(spark)
        assert len(L.train_margin(edges, 7_000, dim=8, epochs=2)[2].collect()) == 2
        assert (shuffled(spark) - before) * 1e6 / 20_000 < 250
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hot_keys_are_found_without_a_shuffle_of_keys(spark):
    facts = spark.range(3_000).selectExpr("if(id < 900, 'a', if(id < 1000, null, concat('k', id))) AS k", "if(id < 1000, 7, id) AS i")
    before = shuffled(spark)
    k, i = S.frequent_keys(facts, ("k", "i"), 300)
    assert [tuple(x) for x in k.collect()] == [("a", 3)] and [tuple(x) for x in i.collect()] == [(7, 4)] and i.dtypes[0] == ("i", "bigint")
    assert (shuffled(spark) - before) * 1e6 < 100_000
    assert S.frequent_keys(facts, ("k",), 5_000) == [None]
