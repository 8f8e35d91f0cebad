"""The discovery loop's inputs."""

from evidra import bindings as B
from evidra.catalog.curating import loop_inputs
from evidra.operators import mining as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_their_parts_once(spark, sf):
    """Components and measurements of the loop are those of the bindings, read from one written join."""
    g = loop_inputs(spark, sf)
    columns = ["formulation_id", "property_type", "value"]
    for mine, theirs in (
        (g.components, B.components(spark, sf).select("formulation_id", "molecule_id")),
        (g.formulation_measurements.select(*columns), B.measurements(spark, sf).select(*columns)),
    ):
        assert "Join" not in plan(mine) and "Join" in plan(theirs)
        assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()


def test_contrasts_place_a_formulations_components_once(spark, monkeypatch):
    comps = spark.createDataFrame([(f, f"m{m}") for f in range(30) for m in range(3)] * 2, "formulation_id int, molecule_id string")
    meas = spark.createDataFrame([(f, "a", float(f)) for f in range(30)], "formulation_id int, property_type string, value double")
    plans, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    M.causal_contrasts(comps, meas, 5).collect()
    star = next(p for p in plans if "molecule_id" in p)
    assert "hashpartitioning(formulation_id" in star
    assert not [line for line in star.splitlines() if "hashpartitioning(formulation_id" in line and ", molecule_id" in line]
