"""Readers and normalisers on small generated files; snapshots and the version step."""

import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from evidra import vocab
from evidra.plans import discovery as D, version_step as V
from evidra.sources import normalize as N, readers as RD, snapshot as SN


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_composition_csv_with_unit_lines(spark, tmp_path):
    p = write(tmp_path / "c.csv", "LiPF_6;EC;PC;EMC;temperature;EIS_conductivity\nm;m;m;m;T;k\ng;g;g;g;C;S/cm\n"
              "1.0;2.0;0;3.0;20;0.01\n1.0;2.0;0;3.0;;0.02\n1.0;2.00001;0;3.0;30;bad\n0.5;0;1;0;25;0.005\n")
    t = N.composition_tables(RD.composition_csv(spark, p))
    assert t.formulations.count() == 2 and t.measurements.count() == 3 and t.components.count() == 5
    assert sorted(r[0] for r in t.measurements.select("temperature").collect()) == [20.0, 25.0, 25.0]
    assert {r["reject_reason"]: r["count"] for r in t.rejects.groupBy("reject_reason").count().collect()} == {"no_masses": 2, "no_value": 1}
    known = {r["id"] for r in t.molecules.collect()}
    assert {r["molecule_id"] for r in t.components.collect()} <= known
    ends = {r["object"] for r in t.relations.where("predicate = 'hasMeasurement'").collect()}
    assert ends == {r["id"] for r in t.measurements.collect()}
    assert t.provenance.count() == 5


def test_composition_csv_comma_sample(spark, tmp_path):
    p = write(tmp_path / "s.csv", "m_EC,m_PC,m_EMC,m_LiPF6,temperature,conductivity\n1,0,2,1,15,0.01\n1,1,2,1,45,0.02\n")
    t = N.composition_tables(RD.composition_csv(spark, p))
    assert t.formulations.count() == 2 and t.components.count() == 7


def test_atlas_csv(spark, tmp_path):
    head = ",".join(vocab.ATLAS_SOLVENTS) + ",salt,c,c units,T,k\n"
    line = lambda ec, dmc, salt, c, unit, t, k: ",".join(
        [str(ec) if s == "EC" else str(dmc) if s == "DMC" else "0" for s in vocab.ATLAS_SOLVENTS] + [salt, str(c), unit, str(t), str(k)]) + "\n"
    p = write(tmp_path / "a.csv", head + line(0.5, 0.5, "LiPF6", 1, "mol/kg", 298.15, 0.01) + line(0.5, 0.5, "LiPF6", 1, "mol/kg", 20, 0.02)
              + line(0, 0, "LiPF6", 1, "mol/l", 20, 0.02) + line(1, 0, "Nope", 1, "mol/l", 20, 0.02) + line(1, 0, "LiBF4", 2, "mol/l", 20, ""))
    t = N.atlas_tables(RD.atlas_csv(spark, p))
    assert t.formulations.count() == 2 and t.components.count() == 5
    assert sorted(round(r[0], 2) for r in t.measurements.select("temperature").collect()) == [20.0, 25.0]
    assert sorted(r["reject_reason"] for r in t.rejects.collect()) == ["no_solvent", "no_value", "unknown_salt"]
    assert {r["unit"] for r in t.components.where("component_type = 'salt'").collect()} == {"m", "M"}
    names = {r["name"].rsplit("-", 1)[0] for r in t.formulations.collect()}
    assert names == {"DMC-EC/LiPF6", "EC/LiBF4"}


def test_experimental_folder(spark, tmp_path):
    base = tmp_path / "datasets" / "raw"
    write(base / "conductivity/EDB-1_conductivity.csv", "solv_1_sm,solv_ratio_1,solv_2_sm,solv_ratio_2,salt_sm,conc_salt,conductivity,temperature\n"
          "C,0.5,CC,0.5,[Li+].X,1,10,\nCC,0.5,C,0.5,[Li+].X,1,20,30\nC,1,,,,1,5,25\nC,1,,,[Li+].X,1,-3,25\n")
    write(base / "oxstab/MP_oxstab.csv", "smiles,IE\nC,8.5\n,9\nCC,\n")
    write(base / "CE/EDB-2_ce.csv", "solvent_1_smiles,solv_1_ratio,salt_1_smiles,salt_1_conc,salt_2_smiles,salt_2_conc,additive_smiles,CE\n"
          "C,1,[Li+].X,1,[Na+].Y,1,F,0.99\nC,1,,,,,F,0.98\n")
    raw = RD.experimental_csv(spark, str(tmp_path))
    cond = N.experimental_conductivity_tables(raw["conductivity"])
    assert cond.formulations.count() == 2
    assert sorted(r[0] for r in cond.measurements.select("value").collect()) == [0.01, 0.02]
    assert N.ionization_tables(raw["ionization"]).measurements.count() == 1
    ce = N.efficiency_tables(raw["efficiency"])
    assert ce.measurements.count() == 1 and ce.components.count() == 2
    assert {(r["role"]) for r in ce.molecule_roles.collect()} == {"solvent", "salt", "additive"}


def test_curated_json(spark, tmp_path):
    doc = {"solvents": [{"name": "Ethylene carbonate", "abbreviation": "EC", "smiles": "C1COC(=O)O1", "properties": {
        "homo_energy": {"value": -7.9, "unit": "eV", "reference": "r"}, "colour": {"value": 1}, "lumo_energy": {"value": None}}}],
        "salts": [{"name": "LiPF6", "smiles": "[Li+].F", "cation": "Li+", "properties": {"lattice_energy": {"value": 700, "unit": "kJ/mol"}}}]}
    t = N.curated_tables(RD.curated_json(spark, write(tmp_path / "c.json", json.dumps(doc))))
    assert sorted((r["property_type"], r["value"]) for r in t.measurements.collect()) == [("homo_energy", -7.9), ("lattice_energy", 700.0)]
    assert t.molecules.count() == 2 and t.rejects.count() == 2


def test_literature_csv(spark, tmp_path):
    p = write(tmp_path / "l.csv", 'Property,Name,Value,Raw_unit,DOI,Extracted_name,Title,Journal,Date\n'
              'Conductivity,LiPF6 @ C,5,mS/cm,10.1/a,[],First,J,"[\'28\', \'2\', \'2018\']"\nConductivity,lipf6,6,mS/cm,10.1/a,[],Second,J,2019-01-01\n'
              'Conductivity,graphite anode,6,mS/cm,10.1/b,[],T,J,\nConductivity,LGPS,12,S/cm,10.1/c,[],T,J,\nVoltage,LiPF6,5,V,10.1/a,[],T,J,\nConductivity,LGPS,-1,S/cm,10.1/c,[],T,J,\n')
    raw = RD.literature_csv(spark, p)
    t = N.literature_tables(raw)
    assert sorted(round(r[0], 6) for r in t.measurements.select("value").collect()) == [0.005, 0.006]
    assert t.measurements.select("owner_id").distinct().count() == 1
    assert {r["source_doi"] for r in t.provenance.collect()} == {"10.1/a"} and {r["confidence"] for r in t.provenance.collect()} == {0.8}
    src = N.literature_sources(N.literature_rows(raw)).collect()
    assert [(r["name"], str(r["published_on"])) for r in src] == [("First", "2018-02-28")]


def test_genome_species_predictions_abbreviations(spark, tmp_path):
    g = [{"task_id": "1", "smiles": "C", "formula": "CH4", "ionization_energy": 12.6, "functional_groups": []}, {"task_id": "2", "smiles": "C", "electron_affinity": 1.0}, {"task_id": "3", "smiles": ""}]
    t = N.genome_tables(RD.genome_json(spark, write(tmp_path / "g.json", json.dumps(g))))
    assert [(r["property_type"], r["value"]) for r in t.measurements.collect()] == [("ionization_energy", 12.6)]
    s = [{"name": "Li2CO3", "SMILES": "X", "charge": -1, "molecule": {"spin_multiplicity": 2}, "energy": 0, "electronic_energy": -3.0, "H": 1.5}, {"molecule_id": "m2", "final_energy": -1.0, "smiles": "Y"}]
    out = {r["name"]: r for r in N.species_table(RD.species(spark, write(tmp_path / "s.json", json.dumps(s)))).collect()}
    assert out["Li2CO3"]["smiles"] == "X" and out["Li2CO3"]["spin_multiplicity"] == 2 and out["Li2CO3"]["energy"] is None and out["Li2CO3"]["enthalpy"] == 1.5
    assert out["m2"]["energy"] == -1.0 and out["m2"]["charge"] == 0 and out["m2"]["spin_multiplicity"] == 1
    csv = RD.species(spark, write(tmp_path / "s.csv", "name,formula,charge,spin_multiplicity,energy\nA,AB,1,1,-2\nB,BC,0,2,-3\n"), max_species=1)
    assert [r["name"] for r in N.species_table(csv).collect()] == ["A"]
    p = N.prediction_tables(RD.predictions_csv(spark, write(tmp_path / "p.csv", "solv_comb_sm,conductivity_log,IE,log_CI\nC,1,9,-2\nCC,9,20,\n,1,9,-2\n")))
    assert sorted((r["property_type"], round(r["value"], 6)) for r in p.measurements.collect()) == [
        ("coulombic_efficiency", 0.99), ("ionic_conductivity", 0.01), ("ionization_energy", 9.0)]
    assert p.molecules.count() == 2
    a = RD.abbreviations(spark, write(tmp_path / "a.csv", "﻿LiPF6 ; Lithium hexafluorophosphate; [Li+].F\nEC ;Ethylene carbonate ;C1\n"))
    assert sorted(tuple(r) for r in a.collect()) == [("EC", "Ethylene carbonate", "C1"), ("LiPF6", "Lithium hexafluorophosphate", "[Li+].F")]


def test_latest_run_and_document(spark, tmp_path):
    write(tmp_path / "runs/discovery-1.json", json.dumps({"run_id": "one", "funnel": {"validated": 1}}))
    newer = write(tmp_path / "runs/discovery-2.json", json.dumps({"run_id": "two", "funnel": {"validated": 2}}))
    os.utime(newer, (time.time() + 50, time.time() + 50))
    assert [r["run_id"] for r in RD.latest_run(spark, str(tmp_path / "runs/discovery-*.json")).collect()] == ["two"]
    doc = {"version": "0.7.0", "molecules": {"m1": {"name": "A", "smiles": "C"}}, "solvents": {}, "relations": [["f1", "hasSolvent", "m1"], ["bad"]]}
    path = tmp_path / "kg.json.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        json.dump(doc, f)
    t = SN.load_document(spark, str(path))
    assert [tuple(r) for r in t["relations"].collect()] == [("f1", "hasSolvent", "m1")]
    body = t["molecules"].select("id", F.get_json_object("body", "$.name").alias("name")).collect()
    assert [tuple(r) for r in body] == [("m1", "A")]


def test_version_step_is_repeatable(spark, tmp_path):
    root = str(tmp_path / "kg")
    p = write(tmp_path / "s.csv", "m_EC,m_PC,m_EMC,m_LiPF6,temperature,conductivity\n1,0,2,1,15,0.01\n")
    q = write(tmp_path / "t.csv", "m_EC,m_PC,m_EMC,m_LiPF6,temperature,conductivity\n1,0,2,1,15,0.01\n3,1,2,1,45,0.02\n")
    SN.save_tables(N.union_tables([N.composition_tables(RD.composition_csv(spark, p))]), root, "1")
    for _ in range(2):
        delta = V.step(spark, root, "1", "2", N.union_tables([N.composition_tables(RD.composition_csv(spark, q))]))
        got = {r["metric"]: r["delta"] for r in delta.collect()}
        assert (got["formulations"], got["components"], got["measurements"]) == (1, 4, 1)
    assert SN.load_table(spark, root, "molecules").select("version").distinct().count() == 2


def test_versions_from_unrelated_files_lose_nothing(spark, tmp_path):
    head = "m_EC,m_PC,m_EMC,m_LiPF6,temperature,conductivity\n"
    files = [head + "1,0,2,1,15,0.01\n", head + "3,1,2,1,45,0.02\n", head + "3,1,2,1,45,0.02\n1,0,2,1,15,0.03\n"]
    parts = [N.union_tables([N.composition_tables(RD.composition_csv(spark, write(tmp_path / f"{i}.csv", f)))]) for i, f in enumerate(files)]
    root = str(tmp_path / "kg")
    SN.save_tables(parts[0], root, "1")
    for i in (1, 2):
        V.step(spark, root, str(i), str(i + 1), parts[i])
    load = lambda n: SN.load_version(spark, root, n, "3")
    found = load("measurements").join(load("formulations").select(F.col("id").alias("owner_id"), F.col("source_row_id").alias("first_row")), "owner_id")
    assert sorted((r["temperature"], r["value"]) for r in found.collect()) == [(15.0, 0.01), (15.0, 0.03), (45.0, 0.02)]
    edges = {(r["subject"], r["object"]) for r in load("relations").where("predicate = 'hasMeasurement'").collect()}
    assert edges == {(r["owner_id"], r["id"]) for r in found.collect()}
    about = {r["entity_id"] for r in load("provenance").collect()}
    assert about >= {r["id"] for r in found.collect()} | {r["owner_id"] for r in found.collect()}
    # Only what is new is written.
    assert [SN.load_table(spark, root, "measurements", v).count() for v in "123"] == [1, 1, 1]


def test_ids_do_not_follow_the_layout(spark, tmp_path):
    rows = [f"{i % 7},0,2,1,15,0.0{i % 3 + 1}" for i in range(40)]
    head = "m_EC,m_PC,m_EMC,m_LiPF6,temperature,conductivity\n"
    one = write(tmp_path / "one/a.csv", head + "\n".join(rows) + "\n")
    for i in range(4):
        write(tmp_path / f"four/{i}.csv", head + "\n".join(rows[i::4]) + "\n")
    ids = lambda df: sorted(r["id"] for r in N.composition_tables(df).measurements.collect())
    want = ids(RD.composition_csv(spark, one))
    assert len(set(want)) == 40
    assert ids(RD.composition_csv(spark, str(tmp_path / "four"))) == want
    again = spark.read.csv(one, header=True)
    assert all(ids(RD.numbered(again.repartition(n))) == want for n in (1, 4, 50))


def test_overlapping_sources_count_once(spark, tmp_path):
    p = write(tmp_path / "s.csv", "m_EC,m_PC,m_EMC,m_LiPF6,temperature,conductivity\n1,0,2,1,15,0.01\n")
    raw = RD.composition_csv(spark, p)
    both = N.union_tables([N.composition_tables(raw), N.composition_tables(raw), N.formulation_tables(N.composition_rows(raw), "other", None, "ionic_conductivity", "S/cm")])
    assert (both["formulations"].count(), both["components"].count(), both["measurements"].count()) == (1, 3, 2)
    owner = both["formulations"].first()["id"]
    assert sorted(r["activity_id"] or str(r["source_ids"]) for r in both["provenance"].where(F.col("entity_id") == owner).collect()).__len__() == 2


def test_quick_discovery_preset(spark, sf):
    from evidra.catalog.curating import loop_inputs

    g = loop_inputs(spark, sf)
    found = D.run_quick(g, min_confidence=0.01, validation_threshold=0.2)
    funnel = {r["stage"]: r["n"] for r in found.funnel.collect()}
    assert 0 < funnel["hypotheses_generated"] <= 20
    assert funnel["validated"] + funnel["rejected"] + funnel["inconclusive"] == funnel["hypotheses_generated"]
    assert found.gaps.where("gap_type = 'missing_sameAs_link'").count() == 0


@pytest.fixture
def sixteen_shuffle_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows_are_spread_over_tasks(spark, monkeypatch, sixteen_shuffle_tasks, parts):
    """Half of all rows are equal; ids are those of their number, whatever the layout, and no task gets them all."""
    from evidra.sources import readers

    monkeypatch.setattr(readers, "COPIES", 100)
    table = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("v")).repartition(parts)
    out = readers.numbered(table)
    same = out.where("v = 'same'")
    first = same.agg(F.min("row_id")).first()[0]
    assert {r.row_id for r in same.select("row_id").collect()} == {first} | {f"{first}-{k}" for k in range(2, 10_001)}
    assert out.count() == 20_000 and out.select("row_id").distinct().count() == 20_000
    most = same.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert most < 2_500


def test_species_with_measured_zero_match_sql(spark, tmp_path):
    from evidra.catalog import load_all
    from tools.check_oracle import compare
    import duckdb

    rows = [(1, 4, "view", 0.0), (2, 5, "click", 0.0), (3, 6, "click", 60.0), (4, 7, "cart", 0.0), (5, 8, "cart", 3.0), (6, 9, "view", None)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(load_all()["species_table"], spark, con, str(tmp_path)) == "ok 6"
