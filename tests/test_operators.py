"""Hand-made fixtures, brute-force comparisons and invariants."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from evidra.functions import pvalues as P, scalar as S
from evidra.operators import (
    curation as C, enrichment as E, evaluation as EV, gaps as G, hypotheses as H, identity as I,
    linkpred as L, mining as M, ranking as R, relational as REL, skew, stats as ST,
)


def rows(df):
    return [tuple(r) for r in df.collect()]


def random_mixtures(seed=1, n=60):
    rnd = random.Random(seed)
    comps, meas = [], []
    for f in range(n):
        for pos in range(rnd.randint(1, 5)):
            comps.append((f, f"m{rnd.randint(0, 6)}", float(rnd.randint(1, 9)), pos))
        for _ in range(rnd.randint(0, 3)):
            meas.append((f, "p", rnd.gauss(10, 3) + f % 3, float(rnd.choice([0, 15, 20, 25, 40]))))
    return comps, meas


@pytest.fixture(scope="module")
def mixtures(spark):
    comps, meas = random_mixtures()
    c = spark.createDataFrame(comps, "formulation_id long, molecule_id string, amount double, position int")
    m = spark.createDataFrame(meas, "formulation_id long, property_type string, value double, temperature double")
    return comps, meas, c, m


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    data = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)] + [("cold", rnd.random()) for _ in range(7)] + [("one", 5.0)]
    df = spark.createDataFrame(data + [("hot", float("nan")), ("hot", None)], "k string, v double")
    got = {r["k"]: r for r in R.exact_quantiles(df, ["k"], "v", [0.1, 0.25, 0.75], ["a", "b", "c"]).collect()}
    for k in ("hot", "cold", "one"):
        values = [v for g, v in data if g == k]
        assert got[k]["n"] == len(values)
        assert np.allclose([got[k][c] for c in "abc"], np.percentile(values, [10, 25, 75]))


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_global_rank_does_not_depend_on_partitions(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
        out = R.global_row_number(df, [F.desc("v"), F.asc("id")]).toPandas().sort_values("rank")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    expected = pd.DataFrame({"id": range(500)}).assign(v=lambda d: d.id % 7).sort_values(["v", "id"], ascending=[False, True])
    assert list(out["id"]) == list(expected["id"]) and list(out["rank"]) == list(range(1, 501))


def t_tails(spark, rows):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t double, dof double")
    return [r.p for r in table.withColumn("p", P.t_pvalue(F.col("t"), F.col("dof"))).orderBy("i").collect()]


def test_t_tail_against_tables(spark):
    # Two-sided 5 % and 1 % critical values.
    t = [12.706, 2.228, 1.960, 63.657, -2.576, 0.0]
    dof = [1.0, 10.0, 1e9, 1.0, 1e9, 5.0]
    assert np.allclose(t_tails(spark, zip(t, dof)), [0.05, 0.05, 0.05, 0.01, 0.01, 1.0], atol=2e-4)
    inf, nan = float("inf"), float("nan")
    assert t_tails(spark, [(nan, 3.0), (1.0, 0.0), (None, 3.0), (1.0, None), (1.0, -2.0)]) == [None] * 5
    assert t_tails(spark, [(inf, 3.0), (-inf, 3.0)]) == [0.0, 0.0]


def test_t_tail_against_closed_forms(spark):
    """One formula from one degree of freedom to a million millions, in the far tail as well."""
    steps = [0.0, 1e-6, 0.01, 0.3, 1.0, 2.5, 6.0, 40.0, 1e4]
    rows, want = [], []
    for t in steps:
        rows += [(t, 1.0), (t, 2.0)]
        want += [2 / math.pi * math.atan2(1, t), 2 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t))]
        for dof in (4, 30, 1000, 20_000):  # finite series for even numbers
            sine, cosine2 = t / math.sqrt(dof + t * t), dof / (dof + t * t)
            term = total = 1.0
            for k in range(1, dof // 2):
                term *= (2 * k - 1) / (2 * k) * cosine2
                total += term
            rows.append((t, float(dof)))
            want.append(1 - sine * total)
        rows += [(t, 1e12)]
        want.append(math.erfc(t / math.sqrt(2)))
    got = t_tails(spark, rows)
    assert np.abs(np.array(got) - want).max() < 1e-10
    far = {r: g for r, g in zip(rows, got)}
    assert math.isclose(far[6.0, 1e12], math.erfc(6 / math.sqrt(2)), rel_tol=1e-9)
    assert math.isclose(far[1e4, 1.0], 2 / math.pi * math.atan2(1, 1e4), rel_tol=1e-9)


def test_t_tail_stays_in_the_jvm(spark):
    plan = spark.range(3).select(P.t_pvalue(F.col("id"), F.lit(4)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_presence_effect_brute_force(mixtures):
    comps, meas, c, m = mixtures
    got = {r["component_id"]: r for r in M.presence_effects(c, m, "p", 1, 0.0).collect()}
    allv = [v for _, _, v, _ in meas]
    listed = {}
    for f, mol, *_ in comps:
        listed.setdefault(f, []).append(mol)
    for mol in {x for x, in [(c[1],) for c in comps]}:
        w = [v for f, _, v, _ in meas for x in listed[f] if x == mol]
        wo = [v for f, _, v, _ in meas if mol not in listed[f]]
        if not w or not wo:
            continue
        effect = (np.mean(w) - np.mean(wo)) / (np.std(allv) + 1e-8)
        assert got[mol]["correlation"] == pytest.approx(effect) and got[mol]["num_samples"] == len(w)


def test_amount_correlation_brute_force(mixtures):
    comps, meas, c, m = mixtures
    got = {r["component_id"]: r["correlation"] for r in M.amount_correlations(c, m, "p", 0.0).collect()}
    last = {}
    for f, mol, a, pos in sorted(comps, key=lambda r: (r[3], r[2])):
        last[(f, mol)] = a
    kept = [(f, v) for f, _, v, t in meas if t == 0 or 15 <= t <= 25]
    for mol in {c[1] for c in comps}:
        x = [last.get((f, mol), 0.0) for f, _ in kept]
        assert got[mol] == pytest.approx(np.corrcoef(x, [v for _, v in kept])[0, 1])


def test_pair_counts_brute_force_and_salted(mixtures, monkeypatch):
    comps, _, c, _ = mixtures
    bag, sets = {}, {}
    for _, group in itertools.groupby(sorted(comps), key=lambda r: r[0]):
        mols = [r[1] for r in group]
        for a, b in itertools.combinations(mols, 2):
            k = tuple(sorted((a, b)))
            bag[k] = bag.get(k, 0) + 1
        for k in itertools.combinations(sorted(set(mols)), 2):
            sets[k] = sets.get(k, 0) + 1
    for hot in (M.HOT_FORMULATION, 1):
        monkeypatch.setattr(M, "HOT_FORMULATION", hot)
        mult = M.multiplicities(c)
        assert {(a, b): n for a, b, n in rows(M.pair_counts(mult))} == sets
        assert {(a, b): n for a, b, n in rows(M.pair_counts(mult, F.col("m_1") * F.col("m_2")))} == {
            k: n for k, n in bag.items() if k[0] != k[1]}
    rules = {(r["antecedent"], r["consequent"]): r for r in M.co_occurrence_rules(c, 1, 0.0).collect()}
    assert {tuple(sorted(k)) for k in rules} == set(bag)
    for (a, b), r in rules.items():
        assert r["support"] == bag[tuple(sorted((a, b)))]


def test_lift_is_symmetric_and_capped(mixtures):
    *_, c, _ = mixtures
    out = M.association_lift(c, 1, 0.0).collect()
    n = c.select("formulation_id").distinct().count()
    for r in out:
        assert r["comp_1"] < r["comp_2"]
        assert r["lift"] == pytest.approx(r["pair_count"] * n / (r["freq_1"] * r["freq_2"]))
        assert r["confidence"] == pytest.approx(min(1.0, r["lift"] / 2))


def test_causal_contrast_equals_regression_t_test(spark, mixtures):
    comps, meas, c, m = mixtures
    out = {r["molecule_id"]: r for r in M.causal_contrasts(c, m, 5).collect()}
    has = {(f, mol) for f, mol, *_ in comps}
    for mol in ("m0", "m3"):
        w = [v for f, _, v, _ in meas if (f, mol) in has]
        wo = [v for f, _, v, _ in meas if (f, mol) not in has]
        r = out[mol]
        assert (r["n_with"], r["n_without"]) == (len(w), len(wo))
        assert r["effect_size"] == pytest.approx((np.mean(w) - np.mean(wo)) / np.std(wo))
        data = spark.createDataFrame([(float((f, mol) in has), v) for f, _, v, _ in meas], "x double, label double")
        fit = LinearRegression(solver="normal").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(data))
        assert r["t_statistic"] == pytest.approx(fit.summary.tValues[0])
        assert r["p_value"] == pytest.approx(fit.summary.pValues[0], abs=1e-9)


def test_causal_contrasts_write_no_row_per_formulation(spark, monkeypatch):
    rng = np.random.default_rng(3)
    comps = spark.createDataFrame([(f, f"m{m}") for f in range(60) for m in range(4) if rng.random() < 0.5 or f == 7] * 2, "formulation_id int, molecule_id string")
    meas = spark.createDataFrame([(f, p, float(rng.normal())) for f in range(62) for p in "ab" for _ in range(30 if f == 7 else 2)] + [(None, "a", 1.0)], "formulation_id int, property_type string, value double")
    written, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    result = lambda: {(r["molecule_id"], r["property_type"]): r[2:] for r in M.causal_contrasts(comps, meas, 5).collect()}
    plain = result()
    assert len(plain) == 8 and max(t.count() for t in written) <= 8
    monkeypatch.setattr(M, "HEAVY_ROWS", 10)  # formulation 7 is summed before it travels
    heavy = result()
    assert plain.keys() == heavy.keys()
    for k, r in plain.items():
        assert heavy[k] == pytest.approx(r)


def test_property_correlation_skips_constants(spark):
    data = [(e, "a", float(e), 0) for e in range(12)] + [(e, "b", 2.0 * e + (e % 2), 0) for e in range(12)] + [(e, "c", 1.0, 0) for e in range(12)]
    df = spark.createDataFrame(data, "entity_id int, property_type string, value double, x int")
    out = ST.property_correlations(df).collect()
    assert [(r["property_1"], r["property_2"]) for r in out] == [("a", "b")]
    x, y = np.arange(12), 2 * np.arange(12) + np.arange(12) % 2
    assert out[0]["r"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and out[0]["p_value"] < 1e-6


def test_iqr_needs_ten_values_and_few_outliers(spark):
    base = [("p", float(i)) for i in range(30)]
    one = spark.createDataFrame([(i, *r) for i, r in enumerate(base + [("p", 1000.0)] + [("q", 1.0)] * 8 + [("q", 99.0)])], "id int, property_type string, value double")
    assert [(r["id"], r["n_outliers"]) for r in ST.iqr_outliers(one).select("id", "n_outliers").collect()] == [(30, 1)]


def molecules(spark, data):
    cols = "id string, name string, smiles string, inchi string, inchi_key string, pubchem_cid long, cas_number string, molecular_weight double, synonyms array<string>"
    return spark.createDataFrame([(*r, *([None] * (8 - len(r))), ["s" + r[0]]) for r in data], cols)


def test_dedup_prefers_real_then_longer_names_and_is_idempotent(spark):
    m = molecules(spark, [("1", "C=C", "X"), ("2", "water", " X "), ("3", "waters", "X", "InChI"), ("4", "waterz", "X"), ("5", "solo", None), ("6", "", "Y")])
    mapping = I.duplicate_map(m)
    assert sorted(rows(mapping)) == [("1", "3", "X"), ("2", "3", "X"), ("4", "3", "X")]
    merged = I.merged_molecules(m)
    kept = {r["id"]: r for r in merged.collect()}
    assert set(kept) == {"3", "5", "6"} and kept["3"]["inchi"] == "InChI" and kept["3"]["n_merged"] == 4
    assert sorted(r[1] for r in rows(I.merged_synonyms(m)) if r[0] == "3") == ["C=C", "s1", "s2", "s3", "s4", "water", "waterz"]
    again = I.duplicate_map(merged.withColumn("synonyms", F.array()))
    assert again.count() == 0
    edges = spark.createDataFrame([("1", "sameAs", "2"), ("1", "hasX", "5"), ("4", "hasX", "5"), ("5", "sameAs", "5")], "subject string, predicate string, object string")
    rewritten = I.rewrite_edges(edges, mapping)
    assert rewritten.count() == 4 and rewritten.where("rewritten").count() == 3
    assert sorted(rows(I.compact_edges(rewritten))) == [("3", "hasX", "5")]
    assert {r[0]: r[1] for r in rows(I.dedup_stats(m, edges))}["molecules_after"] == 3


def test_salted_lookup_equals_join(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i int, k string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    for how in ("left", "inner"):
        got = skew.salted_lookup(facts, lookup, "k", how, hot_rows=10).select("i", "v")
        assert sorted(rows(got), key=str) == sorted(rows(facts.join(lookup, "k", how).select("i", "v")), key=str)


def test_null_and_hot_keys_are_dealt_over_tasks(spark):
    """No join partition gets over three times the mean where nine tenths of the keys are null or three tenths are one key."""
    n, parts = 20_000, 8
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    for key in (F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id"))), F.when(F.col("id") % 10 < 3, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id")))):
        facts = spark.range(n).select("id", key.alias("k"))
        hot = skew.hot_keys(facts, "k", hot_rows=200)
        salted = skew.lookup_with(facts, lookup, "k", "left", hot)
        assert salted.count() == n
        plan = skew.lookup_with(facts, lookup.hint("shuffle_hash"), "k", "left", hot)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            sizes = [r["n"] for r in plan.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert max(sizes) <= 3 * n / parts


def test_one_job_counts_the_keys_of_all_lookups(spark):
    facts = spark.range(1000).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").alias("b"))
    hot = skew.hot_keys_of(facts, ["a", "b"], hot_rows=100)
    assert hot[1] is None and {r["a"]: r["_salts"] for r in hot[0].collect()} == {str(i): 2 for i in range(7)}


def test_same_as_star_has_the_closure_of_all_pairs(spark):
    m = molecules(spark, [("a", "n", "X"), ("b", "n", "X"), ("c", "n", " X"), ("d", "n", "Y"), ("e", "n", None)])
    star = I.same_as_star(m)
    assert star.count() == 4
    comps = I.connected_components(star.select(F.col("subject").alias("a"), F.col("object").alias("b")))
    assert sorted(rows(comps)) == [("a", "a"), ("b", "a"), ("c", "a")]
    seeds = spark.createDataFrame([("b",)], "id string")
    assert sorted(rows(I.same_as_of(seeds, m))) == [("b", "sameAs", "a"), ("b", "sameAs", "c")]


def test_connected_components_on_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 140)]
    ring = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    out = {i: c for i, c in rows(I.connected_components(spark.createDataFrame(chain + star + ring, "a long, b long")))}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 140)} == {100} and {out[i] for i in range(200, 209)} == {200}


def test_composition_groups_ignore_order_and_rounding(spark):
    data = [(1, "A", 1.0), (1, "B", 2.00001), (2, "B", 2.0), (2, "A", 1.00004), (3, "A", 1.0), (4, "A", 1.0), (4, "A", 1.0)]
    df = spark.createDataFrame(data, "formulation_id int, molecule_id string, amount double")
    assert sorted((r[1], r[2]) for r in rows(I.composition_groups(df))) == [(1, 2), (3, 1), (4, 1)]


def test_missing_links_count_pairs_without_listing_them(spark):
    m = spark.createDataFrame([(f"m{i:03d}", "hot") for i in range(200)] + [("x", "solo")], "id string, smiles string")
    edges = spark.createDataFrame([("m000", "sameAs", "m001"), ("m001", "sameAs", "m000"), ("m002", "sameAs", "m002"), ("m000", "other", "m005")], "subject string, predicate string, object string")
    r = G.missing_link_counts(m, edges).collect()[0]
    assert (r["members"], r["pairs"], r["linked"], r["missing"]) == (200, 19900, 1, 19899)


def test_self_loop_is_outgoing_only_and_constraints(spark):
    e = spark.createDataFrame([("a", "sameAs", "a"), ("a", "coOccursWith", "b"), ("b", "hasMeasurement", "a")], "subject string, predicate string, object string")
    ent = spark.createDataFrame([("a", "A", "solvent", ["al"]), ("b", "B", "salt", [])], "id string, name string, type string, synonyms array<string>")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = sorted((r["direction"], r["predicate"], r["other_id"]) for r in REL.incident_edges(e, ent, seeds).collect())
    assert got == [("outgoing", "coOccursWith", "b"), ("outgoing", "sameAs", "a")]
    alias = spark.createDataFrame([("al", "coOccursWith", "B"), ("al", "coOccursWith", "zzz")], "subject string, predicate string, object string")
    assert rows(REL.induced_subgraph(alias, ent, ent)) == [("a", "coOccursWith", "b")]
    types = spark.createDataFrame([("a", "Molecule"), ("b", "Salt")], "id string, type string")
    bad = REL.constraint_violations(e, types).collect()
    assert sorted((r["predicate"], r["bad_subject"], r["bad_object"]) for r in bad) == [("coOccursWith", False, True), ("hasMeasurement", True, True)]


EVALUATION_CASES = [
    # predicate, evidence, known subject, contradicted -> plausibility, statistical, status
    ("increases", dict(effect_size=6.0, p_value=0.001, n_with=50, n_without=50), True, False, (False, 0.3), (True, 1.0), "inconclusive"),
    ("increases", dict(effect_size=0.05, p_value=0.02, n_with=5, n_without=4), True, False, (True, 0.6), (True, 0.35), "inconclusive"),
    ("increases", dict(effect_size=2.0, p_value=0.2, n_with=50, n_without=50), True, True, (True, 0.9), (False, 0.3), "rejected"),
    ("decreases", dict(effect_size=4.0, p_value=0.001, n_with=50, n_without=50), True, False, (True, 1.0), (True, 1.0), "validated"),
    ("increases", dict(correlation_r=0.97, p_value=0.001, sample_size=60), True, False, (True, 0.48), (True, 1.0), "validated"),
    ("increases", dict(correlation_r=0.5, p_value=0.001, sample_size=15), True, False, (True, 0.42), (True, 0.7), "validated"),
    ("coOccursWith", dict(lift=1.05, co_occurrence_count=50), True, False, (True, 0.5), (True, 1.0), "validated"),
    ("coOccursWith", dict(lift=1.5, co_occurrence_count=5), False, False, (True, 0.7), (True, 1.0), "validated"),
]


@pytest.mark.parametrize("case", range(len(EVALUATION_CASES)))
def test_verdicts(spark, case):
    predicate, ev, known, contradicted, plaus, stat, status = EVALUATION_CASES[case]
    base = spark.range(1).select(
        F.lit("h").alias("hypothesis_id"), F.lit("s").alias("subject"), F.lit(predicate).alias("predicate"), F.lit("property:p").alias("object"),
        F.lit("p").alias("object_name"), F.lit(1.0).alias("confidence"), H.evidence(**{k: F.lit(v) for k, v in ev.items()}))
    mols = spark.createDataFrame([("s" if known else "t",)], "id string")
    opposite = "decreases" if predicate == "increases" else "increases"
    edges = spark.createDataFrame([("s", opposite, "property:p" if contradicted else "other")], "subject string, predicate string, object string")
    stats = spark.createDataFrame([("p",)], "property_type string")
    r = H.evaluate(base, mols, edges, stats, validation_threshold=0.7).collect()[0]
    assert (r["plausibility_passed"], r["plausibility_score"]) == (plaus[0], pytest.approx(plaus[1]))
    assert (r["statistical_passed"], r["statistical_score"]) == (stat[0], pytest.approx(stat[1]))
    assert r["consistency_passed"] is (not contradicted)
    if not contradicted:
        assert r["consistency_score"] == pytest.approx(1.0 if known else 0.8)
    assert r["status"] == status


def test_merge_approved_applies_edits_and_skips(spark):
    hyp = spark.createDataFrame([(f"h{i}", f"s{i}", "affects", "o", 0.5) for i in range(5)] + [("h9", None, "affects", "o", 0.5)],
                                "hypothesis_id string, subject string, predicate string, object string, confidence double")
    d = spark.createDataFrame([
        ("h0", "approved", "ann", "r", "2025-01-01", None), ("h0", "approved", "bob", "r", "2025-01-02", None), ("h1", "approved", "ann", "r", "2025-01-01", {"subject_id": "s0"}),
        ("h2", "approved", "ann", "r", "2025-01-01", {"confidence": "0.9"}), ("h3", "rejected", "ann", "no", "2025-01-01", None), ("h3", "rejected", "bob", "late", "2025-01-05", None),
        ("h4", "approved", "ann", "r", "2025-01-01", None), ("h9", "approved", "ann", "r", "2025-01-01", None), ("unknown", "approved", "ann", "r", "2025-01-01", None)],
        "hypothesis_id string, decision string, curator string, rationale string, decided_at string, modifications map<string,string>")
    graph = spark.createDataFrame([("s4", "affects", "o")], "subject string, predicate string, object string")
    merged = C.merge_approved(d, hyp, graph).orderBy("subject").collect()
    assert [(r["subject"], r["hypothesis_id"], r["curator"], r["confidence"]) for r in merged] == [("s0", "h0", "ann", 0.5), ("s2", "h2", "ann", 0.9)]
    negative = C.negative_evidence(d, hyp.withColumn("status", F.lit("x"))).collect()
    assert [(r["hypothesis_id"], r["rejected_by"], r["status"]) for r in negative] == [("h3", "bob", "rejected")]
    assert C.pending(hyp, d).count() == 0


def test_select_batch_never_cuts_effects(spark):
    effects = spark.createDataFrame([(f"e{i}", "increases", "p", 0.9) for i in range(5)], "subject string, predicate string, object string, confidence double")
    others = spark.createDataFrame([(f"o{i}", "affects", "p", 0.3 + i / 100) for i in range(10)], "subject string, predicate string, object string, confidence double")
    none = spark.createDataFrame([("e0", "increases", "p")], "subject string, predicate string, object string")
    assert sorted(r["subject"] for r in H.select_batch([effects, others], none, 6, 0.0).collect()) == ["e1", "e2", "e3", "e4", "o8", "o9"]
    assert H.select_batch([effects, others], none, 2, 0.0).count() == 4


def test_rank_metrics_are_monotone(spark):
    r = EV.ranking_metrics(spark.createDataFrame([(1,), (2,), (4,), (20,)], "rank int")).collect()[0]
    assert r["hits_at_1"] <= r["hits_at_3"] <= r["hits_at_10"] and r["mrr"] == pytest.approx((1 + 0.5 + 0.25 + 0.05) / 4)


def test_time_slice_ranks_only_hits(spark):
    h = spark.createDataFrame([("a", "s", "p", "1", 0.9, "proposed"), ("b", "s", "p", "2", 0.9, "proposed"), ("c", "s", "p", "3", 0.1, "proposed")],
                              "id string, subject string, predicate string, object string, confidence double, status string")
    post = spark.createDataFrame([("s", "p", "2"), ("s", "p", "3"), ("s", "p", "2")], "subject string, predicate string, object string")
    r = EV.time_slice_result(EV.mark_time_slice(EV.rank_by_confidence(h), post), "2020-01-01").collect()[0]
    assert (r["num_hypotheses"], r["num_appeared_after"], r["avg_rank"]) == (3, 2, 2.5) and r["mrr"] == pytest.approx((1 / 2 + 1 / 3) / 2)
    empty = EV.time_slice_result(EV.mark_time_slice(EV.rank_by_confidence(h.limit(0)), post), "2020-01-01").collect()[0]
    assert empty["hit_rate"] == 0 and math.isinf(empty["avg_rank"])


def test_many_cut_offs_equal_one_at_a_time(spark):
    rows = [(f"h{i}", f"s{i % 7}", "p", f"{i % 11}", (i * 37 % 100) / 100, "proposed") for i in range(60)] + [("n", None, "p", "1", 0.5, "proposed")]
    h = spark.createDataFrame(rows, "id string, subject string, predicate string, object string, confidence double, status string")
    dated = [(f"s{i % 7}", "p", f"{i % 11}", f"2020-{i % 12 + 1:02d}-15" if i % 5 else None) for i in range(40)] + [(None, "p", "1", "2020-12-31")]
    edges = spark.createDataFrame(dated, "subject string, predicate string, object string, d string").withColumn("edge_date", F.to_date("d"))
    cutoffs = ["2020-06-15", "2019-01-01"] + [f"2020-{m:02d}-{d}" for m in range(1, 13) for d in ("01", "15")] + ["2020-06-15"]
    for some in (h, h.limit(0)):
        got = EV.time_slice_experiment(some, edges, cutoffs).collect()
        assert sorted(r["cutoff"] for r in got) == sorted(cutoffs)
        ranked, seen = EV.rank_by_confidence(some).cache(), EV.first_seen(edges).cache()
        for cutoff in ("2019-01-01", "2020-06-15", "2020-12-15"):
            post = EV.time_split(seen, cutoff).where("slice = 'post'")
            want = EV.time_slice_result(EV.mark_time_slice(ranked, post), cutoff).collect()[0]
            for r in (r for r in got if r["cutoff"] == cutoff):
                assert r.asDict() == pytest.approx(want.asDict())


@pytest.mark.parametrize("pivots,block", [(1, 64), (5, 16), (12, 1000)])
def test_nearest_is_exact(spark, pivots, block):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(200, 6))
    vecs[:80] = vecs[0] + rng.normal(size=(80, 6)) * 1e-3  # a third of all entities around one spot
    vecs[150:160] = vecs[150]  # exact copies
    ids = [f"e{i:03d}" for i in range(200)]
    ent = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vecs)], "id string, vec array<double>")
    queries = ent.select(F.col("id").alias("qid"), F.col("id").alias("skip"), "vec")
    got = L.nearest(queries, ent, 4, pivots=pivots, block=block).toPandas()
    for q, v in zip(ids, vecs):
        d = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in zip(ids, vecs) if i != q)[:4]
        mine = got[got.qid == q].sort_values("rank")
        assert list(mine["id"]) == [i for _, i in d]
        assert np.allclose(mine["distance"], [x for x, _ in d], atol=1e-9)


def test_nearest_writes_no_row_per_query_and_pivot(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 16))  # no pivot rules out another's group
    vecs[100:150] += 1e4  # far out, where single precision tells nothing apart
    vecs[150:170] = vecs[150]
    ids = [f"e{i:03d}" for i in range(300)]
    ent = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vecs)], "id string, vec array<double>")
    written, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    got = L.nearest(ent.select(F.col("id").alias("qid"), F.col("id").alias("skip"), "vec"), ent, 3, pivots=8, block=64).toPandas()
    assert max(t.count() for t in written) <= 300
    mine = got.sort_values(["qid", "rank"]).groupby("qid")["id"].agg(list)
    for q, v in zip(ids, vecs):
        d = np.sqrt(((vecs - v) ** 2).sum(1))
        assert mine[q] == [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:3]


def test_translation_training_learns(spark):
    edges = spark.createDataFrame([(i, 0, i + 10) for i in range(10)] + [(i, 1, (i + 1) % 10) for i in range(10)], "h long, r long, t long")
    ent, rel, losses = L.train_transe(edges, dim=8, epochs=4, learning_rate=0.1)
    assert losses[-1] < losses[0] and ent.count() == 20 and rel.count() == 2
    assert all(abs(n - 1) < 1e-9 for n, in rows(ent.select(L.norm(F.col("vec")))))
    names = ent.select(F.col("id").cast("string").alias("id"), "vec")
    preds = rel.select(F.concat(F.lit("p"), "id").alias("id"), "vec")
    asked = spark.createDataFrame([("0", "p0", "10"), ("0", "p0", "nope")], "subject string, predicate string, object string")
    score = {r["object"]: r["score"] for r in L.score_triples(asked, names, preds).collect()}
    assert score["nope"] == float("-inf") and score["10"] > -3
    tails = L.predict_tails(asked.select("subject", "predicate").distinct(), names, preds, 3).collect()
    assert len(tails) == 3 and all(r["object"] != "0" for r in tails)


def test_upsert_keeps_the_last_write(spark):
    a = spark.createDataFrame([(1, "old", 1), (2, "keep", 1)], "id int, v string, seq int")
    b = spark.createDataFrame([(1, "new", 5), (1, "mid", 3)], "id int, v string, seq int")
    assert sorted(rows(REL.upsert(a, b, "id", "seq"))) == [(1, "new", 5), (2, "keep", 1)]


def test_enrichment_priority_and_synonym_limit(spark):
    reg = spark.createDataFrame([
        (7, "CC", "ethane", "I7", "K7", "c7", 30.0, [f"a{i}" for i in range(9)]), (8, "CO", "methanol", "I8", "K8", "c8", 32.0, ["b"]), (9, None, "only name", "I9", None, None, None, None)],
        "registry_id long, smiles string, name string, inchi string, inchi_key string, cas_number string, molecular_weight double, synonyms array<string>")
    m = molecules(spark, [("1", "x", "CO", None, None, 7), ("2", "ETHANE ", " CO"), ("3", "Only Name", ""), ("4", "none", "N")])
    out = {r["id"]: r for r in E.enrich(m, reg).collect()}
    assert [out[i]["matched_by"] for i in "1234"] == ["registry id", "structure", "name", None]
    assert out["1"]["synonyms"] == ["s1", *[f"a{i}" for i in range(9)]] and out["1"]["inchi"] == "I7"
    assert out["2"]["pubchem_cid"] == 8 and out["3"]["pubchem_cid"] == 9 and out["4"]["inchi"] is None
    few = {r["id"]: r for r in E.enrich(m, reg, new_synonyms=5).collect()}
    assert few["1"]["synonyms"] == ["s1", "a0", "a1", "a2", "a3", "a4"]


def test_scalar_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()[0]
    assert value(S.is_electrolyte(F.lit("zz"), F.lit("[{'Li': '1', 'P': '1'}]"))) is True
    assert value(S.is_electrolyte(F.lit("zz"), F.lit("[{'Li': '1'}, {'P': '1'}]"))) is False
    assert value(S.is_electrolyte(F.lit("LiCoO2 electrolyte"), F.lit(""))) is False
    assert value(S.infer_molecule_type(F.lit("NaPX"), F.lit(None).cast("string"))) == "salt"
    assert value(S.infer_molecule_type(F.lit("Nap"), F.lit(""))) == "molecule"
    assert value(S.conductivity_from_log(F.lit(4.0))) is None
    assert str(value(S.publication_date(F.lit("['28', '2', '2018']")))) == "2018-02-28"
    assert value(S.publication_date(F.lit("['31', '2', '2018']"))) is None
    assert value(S.lenient_double(F.lit("NaN"))) is None
    assert value(S.celsius(F.lit(200.0))) == 200.0 and value(S.celsius(F.lit(298.15))) == pytest.approx(25.0)
