"""Coverage gaps: what the graph lacks.

A gap is one row with its count; its entities are a long table, so a gap over a third of all
entities is never packed into one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from evidra import vocab
from evidra.operators import stats

# Priorities by kind of entity without measurements
COVERAGE_PRIORITY = {"solvent": 0.8, "salt": 0.7, "other": 0.5, "formulation": 0.9}
LINK_PRIORITY, PARTIAL_PRIORITY, OUTLIER_PRIORITY = 0.85, 0.7, 0.6


def without_measurements(entities: DataFrame, measured: DataFrame) -> DataFrame:
    """Entities (id, kind) with no measurement; ``measured(entity_id)``."""
    return entities.join(measured.select(F.col("entity_id").alias("id")), "id", "left_anti")


def _priority(kind: str):
    cases = [F.when(F.col(kind) == k, p) for k, p in COVERAGE_PRIORITY.items()]
    return F.coalesce(*cases)


def coverage_gaps(missing: DataFrame) -> DataFrame:
    noun = F.when(F.col("kind") == "other", "molecules").otherwise(F.concat(F.col("kind"), F.lit("s")))
    tail = F.when(F.col("kind") == "formulation", " have no measurements").otherwise(" have no property measurements")
    return missing.groupBy("kind").agg(F.count("*").alias("entity_count")).select(
        F.lit("missing_measurements").alias("gap_type"),
        F.col("kind").alias("detail"),
        "entity_count",
        _priority("kind").alias("priority"),
        F.lit(True).alias("actionable"),
        F.concat(F.col("entity_count"), F.lit(" "), noun, tail).alias("description"),
    )


def missing_link_counts(molecules: DataFrame, relations: DataFrame) -> DataFrame:
    """Per shared key: members, member pairs, linked pairs and pairs lacking a sameAs edge.

    Pairs are counted as n(n-1)/2 and never listed; only existing edges are joined.
    """
    keyed = molecules.where(F.col("smiles").isNotNull() & (F.col("smiles") != "")).select("id", "smiles")
    sizes = keyed.groupBy("smiles").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    same = relations.where((F.col("predicate") == "sameAs") & (F.col("subject") != F.col("object")))
    pairs = same.select(
        F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")
    ).distinct()
    linked = (
        pairs.join(keyed.select(F.col("id").alias("a"), F.col("smiles").alias("smiles")), "a")
        .join(keyed.select(F.col("id").alias("b"), F.col("smiles").alias("smiles_b")), "b")
        .where(F.col("smiles") == F.col("smiles_b"))
        .groupBy("smiles").agg(F.count("*").alias("linked"))
    )
    members = F.col("members")
    return (
        sizes.join(linked, "smiles", "left")
        .withColumn("pairs", F.shiftright(members * (members - 1), 1))
        .withColumn("linked", F.coalesce("linked", F.lit(0)).cast("bigint"))
        .withColumn("missing", F.col("pairs") - F.col("linked"))
    )


def link_gap(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("missing").alias("entity_count"))
    return total.where(F.col("entity_count") > 0).select(
        F.lit("missing_sameAs_link").alias("gap_type"), F.lit("molecule pairs").alias("detail"),
        "entity_count", F.lit(LINK_PRIORITY).alias("priority"), F.lit(True).alias("actionable"),
        F.concat(F.col("entity_count"), F.lit(" molecule pairs share SMILES but lack sameAs links")).alias("description"),
    )


def missing_properties(
    entities: DataFrame, measurements: DataFrame, expected: list[str] = vocab.EXPECTED_SOLVENT_PROPERTIES
) -> DataFrame:
    """(id, missing_property) for entities with at least one property but not all expected ones."""
    has = [F.max(F.col("property_type") == p).alias(f"has_{i}") for i, p in enumerate(expected)]
    flags = measurements.where(F.col("property_type").isNotNull()).groupBy("entity_id").agg(*has)
    known = entities.join(flags.withColumnRenamed("entity_id", "id"), "id")
    lacking = F.array_compact(
        F.array(*[F.when(~F.col(f"has_{i}"), F.lit(p)) for i, p in enumerate(expected)])
    )
    return known.select("id", F.explode(lacking).alias("missing_property"))


def partial_coverage_gaps(missing: DataFrame) -> DataFrame:
    return missing.groupBy("missing_property").agg(F.count("*").alias("entity_count")).select(
        F.lit("partial_property_coverage").alias("gap_type"),
        F.col("missing_property").alias("detail"),
        "entity_count", F.lit(PARTIAL_PRIORITY).alias("priority"), F.lit(True).alias("actionable"),
        F.concat(F.col("entity_count"), F.lit(" solvents missing "), F.col("missing_property"), F.lit(" measurements")).alias("description"),
    )


def outlier_gaps(outliers: DataFrame) -> DataFrame:
    return outliers.groupBy("property_type").agg(F.count("*").alias("entity_count")).select(
        F.lit("potential_outlier").alias("gap_type"), F.col("property_type").alias("detail"),
        "entity_count", F.lit(OUTLIER_PRIORITY).alias("priority"), F.lit(False).alias("actionable"),
        F.concat(F.col("entity_count"), F.lit(" potential outliers in "), F.col("property_type")).alias("description"),
    )


def explore(
    molecules: DataFrame, formulations: DataFrame, measurements: DataFrame, relations: DataFrame,
    expected: list[str] = vocab.EXPECTED_SOLVENT_PROPERTIES,
    coverage: bool = True, links: bool = True, properties: bool = True, outliers: bool = True,
) -> DataFrame:
    """All gaps as rows. molecules(id, role, smiles), formulations(id), measurements(entity_id, ...)."""
    found = []
    if coverage:
        kind = F.when(F.col("role").isin("solvent", "salt"), F.col("role")).otherwise("other")
        entities = molecules.select("id", kind.alias("kind")).unionByName(
            formulations.select("id", F.lit("formulation").alias("kind"))
        )
        found.append(coverage_gaps(without_measurements(entities, measurements)))
    if links:
        found.append(link_gap(missing_link_counts(molecules, relations)))
    if properties:
        solvents = molecules.where(F.col("role") == "solvent").select("id")
        found.append(partial_coverage_gaps(missing_properties(solvents, measurements, expected)))
    if outliers:
        found.append(outlier_gaps(stats.iqr_outliers(measurements)))
    return reduce(DataFrame.unionByName, found)


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Gap count, actionable count and entity total by type."""
    return gaps.groupBy("gap_type").agg(
        F.count("*").alias("gaps"), F.count_if("actionable").alias("actionable"),
        F.sum("entity_count").alias("entities"),
    )


def candidate_tasks(gaps: DataFrame, top_k: int | None = None) -> DataFrame:
    """Actionable gaps as tasks: all of them, or the ``top_k`` of best priority."""
    task = (
        F.when(F.col("gap_type") == "missing_measurements", "predict_property")
        .when(F.col("gap_type") == "missing_sameAs_link", "link_entities")
        .when(F.col("gap_type") == "partial_property_coverage", "complete_properties")
    )
    what = (
        F.when(F.col("gap_type") == "missing_measurements",
               F.concat(F.lit("Predict properties for "), F.when(F.col("detail") == "formulation", "entity").otherwise(F.col("detail"))))
        .when(F.col("gap_type") == "missing_sameAs_link", "Create sameAs links for matching SMILES")
        .otherwise(F.concat(F.lit("Predict "), F.col("detail"), F.lit(" for solvents")))
    )
    tasks = gaps.where(F.col("actionable") & task.isNotNull()).select(
        task.alias("task"), what.alias("description"), "priority", F.col("gap_type").alias("source_gap"), "detail")
    return tasks if top_k is None else tasks.orderBy(F.desc("priority"), "source_gap", "detail").limit(top_k)


def task_targets(missing: DataFrame, per_gap: int = 100) -> DataFrame:
    """The first target entities (id order) of each gap; ``missing(id, gap)``."""
    first = Window.partitionBy("gap").orderBy("id")
    return missing.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_gap)
