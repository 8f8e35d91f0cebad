"""Ablation from sums of products, against fits one by one; sparse features."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import evaluation as EV

COMPONENT = "formulation_id long, molecule_id string, amount double, position int"


@pytest.fixture(scope="module")
def mixture(spark):
    random.seed(3)
    comps, labels = [], []
    for f in range(120):
        own = random.sample("abcdefg", random.randint(0, 5))
        comps += [(f, m, random.choice([0.0, 1.0, 2.5, 7.0]), p) for p, m in enumerate(own)]
        labels.append((f, 3.0 * ("a" in own) + sum(ord(m) % 5 for m in own) + random.random()))
    comps += [(0, "b", 4.0, 90), (0, "b", 9.0, 91), (1, "c", None, 92), (None, "a", 1.0, 1), (500, "h", 1.0, 1), (2, None, 1.0, 93)]
    return comps, labels, spark.createDataFrame(comps, COMPONENT).repartition(4), spark.createDataFrame(labels, "formulation_id long, label double")


def last_amounts(comps):
    out = {}
    for f, m, a, p in sorted((c for c in comps if None not in c), key=lambda c: c[3]):
        out[f, m] = a
    return out


def test_sparse_rows_hold_every_component(mixture):
    comps, labels, c, y = mixture
    ids, rows = EV.sparse_features(c, y)
    place = {r.molecule_id: r.idx for r in ids.collect()}
    assert [m for m, _ in sorted(place.items(), key=lambda x: x[1])] == list("abcdefgh") and sorted(place.values()) == list(range(8))
    amounts = last_amounts(comps)
    got = {r.formulation_id: list(zip(r.indices, r.amounts)) for r in rows.collect()}
    assert got == {f: sorted((place[m], a) for (g, m), a in amounts.items() if g == f) for f, _ in labels}


def test_more_components_than_a_row_has_columns(spark):
    """Sparse rows know no limit on the number of components."""
    comps = spark.range(12_000).select((F.col("id") % 3000).alias("formulation_id"), F.format_string("m%05d", "id").alias("molecule_id"), F.lit(2.0).alias("amount"), F.lit(1).alias("position"))
    ids, rows = EV.sparse_features(comps, spark.range(3000).select(F.col("id").alias("formulation_id"), F.lit(1.0).alias("label")))
    assert ids.count() == 12_000
    assert rows.agg(F.sum(F.size("indices")), F.max(F.size("indices"))).first() == (12_000, 4)


def test_fold_errors_are_those_of_separate_fits(spark, mixture):
    comps, labels, c, y = mixture
    asked = [("h1", "a"), ("h2", "c"), ("h3", "no such"), ("h4", "h"), ("h5", None), ("h6", "a")]
    hypotheses = spark.createDataFrame(asked, "hypothesis_id string, molecule_id string")
    got = {(r.hypothesis_id, r.fold): r for r in EV.linear_errors(c, y, hypotheses, 3, fold=F.col("formulation_id") % 3).collect()}
    assert len(got) == len(asked) * 3
    amounts = last_amounts(comps)
    X = np.array([[1.0] + [amounts.get((f, m), 0.0) for m in "abcdefgh"] for f, _ in labels])
    t = np.array([v for _, v in labels])

    def rmse(X, k):
        test = np.arange(len(t)) % 3 == k
        w = np.linalg.solve(X[~test].T @ X[~test] + 1e-3 * np.eye(X.shape[1]), X[~test].T @ t[~test])
        return math.sqrt(np.mean((t[test] - X[test] @ w) ** 2))

    for (h, m) in asked:
        column = "abcdefgh".find(m or "?")
        flag = (X[:, column + 1 : column + 2] > 0) if column >= 0 else np.zeros((len(t), 1))
        for k in range(3):
            assert math.isclose(got[h, k].baseline_rmse, rmse(X, k), rel_tol=1e-7)
            assert math.isclose(got[h, k].with_edge_rmse, rmse(np.hstack([X, flag]), k), rel_tol=1e-7)


def test_top_hypotheses_and_too_few_rows(spark, mixture):
    _, _, c, y = mixture
    hypotheses = spark.createDataFrame([("h1", "a", 0.2), ("h2", "c", 0.9), ("h3", "d", 0.9)], "hypothesis_id string, molecule_id string, confidence double")
    assert {r.hypothesis_id for r in EV.linear_ablation(c, y, hypotheses, 3, top_k=2).collect()} == {"h2", "h3"}
    found = {r.hypothesis_id: r for r in EV.linear_ablation(c, y, hypotheses, 3).collect()}
    assert len(found) == 3 and found["h1"].num_folds == 3 and found["h1"].status in ("validated", "proposed", "rejected")
    for few in (y.where("formulation_id < 5"), y.limit(0)):
        rows = EV.linear_ablation(c, few, hypotheses, 3).collect()
        assert [(r.num_folds, r.delta_rmse, r.is_significant, r.status, math.isnan(r.baseline_rmse)) for r in rows] == [(0, 0.0, False, "proposed", True)] * 3
    assert EV.linear_ablation(c.limit(0), y, hypotheses, 3).count() == 3


def test_feature_matrix_sends_no_wide_rows(spark):
    c = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", 3.0, 2), (2, "b", 4.0, 1), (3, None, 5.0, 1)], "formulation_id int, molecule_id string, amount double, position int")
    labels = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "formulation_id int, label double")
    out = EV.feature_matrix(c, labels, ["a", "b"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1.0, 2.0, 3.0), (2, 2.0, 0.0, 4.0), (3, 3.0, 0.0, 0.0)]
    lines = [line.split("- ")[-1] for line in out._jdf.queryExecution().executedPlan().toString().splitlines()]
    wide = next(i for i, line in enumerate(lines) if "partial_max(" in line and "partial_max_by" not in line)
    assert "Exchange" not in lines[wide - 1]
