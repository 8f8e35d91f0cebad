"""Versioned tables: replaying, merging, deleting and compacting against a plain replay."""

import random

import pytest

from evidra.plans import version_step as V
from evidra.sources import changelog as CL, snapshot as SN

ROW = "k long, a string, b double, name string, s long"
RULES = {"t": {"b": "first", "name": "name"}}


def plain_replay(versions):
    """State by key of (upserts, deletes) per version, row by row."""
    state, first = {}, {}
    better = lambda n: (any(c in n for c in "()[]=#@+-/\\"), -len(n), n)
    for upserts, deletes in versions:
        for k in deletes:
            state.pop(k, None)
        for k, a, b, name, _ in sorted(upserts, key=lambda r: r[4]):
            if k is None:
                continue
            old = state.setdefault(k, [None, None, None])
            old[0] = a if a is not None else old[0]
            old[1] = b if old[1] is None else old[1]
            if name is not None and (old[2] is None or better(name) < better(old[2])):
                old[2] = name
    return {k: tuple(v) for k, v in state.items()}


def some_versions(seed, n=5):
    rng = random.Random(seed)
    names = [None, "ethylene", "C=C", "ec", "propylene carbonate", "O=C1OCCO1", "é"]
    out = []
    for v in range(n):
        rows = [(rng.choice([None, *range(12)]), rng.choice([None, "x", "y", "z"]), rng.choice([None, 1.5, 2.5]), rng.choice(names), 100 * v + i) for i in range(rng.randint(0, 25))]
        out.append((rows, [rng.randrange(14) for _ in range(rng.randint(0, 3))] if v else []))
    return out


@pytest.mark.parametrize("seed, compacted", [(1, None), (2, 2), (3, 4), (4, 0)])
def test_any_log_reads_as_a_plain_replay(spark, tmp_path, seed, compacted):
    root, versions = str(tmp_path / "kg"), some_versions(seed)
    for v, (rows, gone) in enumerate(versions):
        CL.append(
            spark, root, "t", str(v), str(v - 1) if v else None, spark.createDataFrame(rows, ROW).repartition(1 + v), spark.createDataFrame([(k,) for k in gone], "k long") if gone else None,
            ["k"], seq="s",
        )
        if v == compacted:
            CL.compact(spark, root, "t", str(v), ["k"], RULES)
    for v in range(len(versions)):  # earlier versions stay readable beside a compacted one
        got = {r.k: (r.a, r.b, r.name) for r in CL.load(spark, root, "t", str(v), ["k"], RULES).collect()}
        assert got == plain_replay(versions[: v + 1]), v


def test_compaction_is_where_reading_starts(spark, tmp_path):
    root = str(tmp_path / "kg")
    for v in range(3):
        CL.append(spark, root, "t", str(v), str(v - 1) if v else None, spark.createDataFrame([(v, "x", None, None, 0)], ROW), keys=["k"])
    CL.compact(spark, root, "t", "1", ["k"])
    assert [p.rsplit("/", 3)[-3:-1] for p in CL._parts(spark, root, "t", "2")] == [["kg", "t"], ["_base", "t"]]
    CL.compact(spark, root, "t", "2", ["k"])
    assert sorted(r.k for r in CL.load(spark, root, "t", "2", ["k"]).collect()) == [0, 1, 2]


def test_a_step_names_stored_molecules_updates_and_deletes(spark, tmp_path):
    root = str(tmp_path / "kg")
    mol, role = "id string, name string, smiles string", "molecule_id string, role string"
    SN.save_tables({"molecules": spark.createDataFrame([("m1", None, "CO"), ("m2", "C=O", None), ("m3", "old", "N")], mol),
                    "molecule_roles": spark.createDataFrame([("m1", "solvent"), ("m3", "salt")], role)}, root, "1")
    new = {"molecules": spark.createDataFrame([("m1", "methanol", "XX"), ("m2", "formaldehyde", "C=O"), ("m4", "new", None)], mol),
           "molecule_roles": spark.createDataFrame([("m1", "solvent"), ("m4", "salt")], role)}
    gone = {"molecules": spark.createDataFrame([("m3",)], "id string"), "molecule_roles": spark.createDataFrame([("m3", "salt")], role)}
    for _ in range(2):
        V.step(spark, root, "1", "2", new, deletes=gone)
        rows = {tuple(r) for r in SN.load_version(spark, root, "molecules", "2").select("id", "name", "smiles").collect()}
        assert rows == {("m1", "methanol", "CO"), ("m2", "formaldehyde", "C=O"), ("m4", "new", None)}
        roles = {tuple(r) for r in SN.load_version(spark, root, "molecule_roles", "2").select("molecule_id", "role").collect()}
        assert roles == {("m1", "solvent"), ("m4", "salt")}
    # Saying the same again writes nothing.
    V.step(spark, root, "2", "3", new)
    assert SN.load_table(spark, root, "molecules", "3").count() == 0
    assert {r.id for r in SN.load_version(spark, root, "molecules", "1").collect()} == {"m1", "m2", "m3"}


def test_empty_logs_and_plain_tables(spark, tmp_path):
    root = str(tmp_path / "kg")
    CL.append(spark, root, "t", "0", None, spark.createDataFrame([], ROW), keys=["k"])
    assert CL.load(spark, root, "t", "0", ["k"]).count() == 0
    plain = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "k long, a string")
    assert [tuple(r) for r in CL.replayed(plain, ["k"]).collect()] == [(1, "x")]
    assert [tuple(r) for r in CL.replayed(plain.select("k"), ["k"]).collect()] == [(1,)]


def test_explained_edges_keep_their_counts(spark):
    from evidra.operators import provenance as P

    edges = spark.createDataFrame([("1", "sameAs", "2", 3), ("1", "increases", "x", 1), (None, "decomposesTo", "2", 2)], "subject string, predicate string, object string, copies long")
    mols = spark.createDataFrame([("1", "C"), ("2", "C")], "id string, smiles string")
    hyp = spark.createDataFrame([("h", "1", "increases", "x", "rule", 0.5)], "id string, subject string, predicate string, object string, source string, confidence double")
    out = {r["predicate"]: (r["copies"], r["inference_method"]) for r in P.explain_relations(edges, mols, hyp).collect()}
    assert out == {"sameAs": (3, "SMILES_matching"), "increases": (1, "rule"), "decomposesTo": (2, "literature_knowledge")}
