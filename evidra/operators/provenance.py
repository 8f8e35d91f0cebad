"""Tracing values and edges back to their sources.

``provenance(id, entity_id, entity_type, source_ids, source_doi, source_row_id, activity_id,
extraction_method, confidence, validated)`` and ``sources(id, name, doi, url, source_type)``.
All operators work on sets of entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidra import vocab
from evidra.functions import scalar
from evidra.operators.relational import SPO
from evidra.operators.skew import salted_lookup, salted_lookups


def is_complete() -> Column:
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (F.coalesce(F.size("source_ids"), F.lit(0)) > 0) | filled("source_doi") | filled("activity_id")


def completeness(provenance: DataFrame, formulations: DataFrame, measurements: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Two readings of completeness over formulations, measurements and hypotheses.

    ``as_reference`` divides all complete records by the entities in scope and can pass 1;
    ``as_documented`` is the share of in-scope entities with a complete record.
    """
    ids = lambda df: df.select(F.col("id").cast("string").alias("entity_id"))
    scope = ids(formulations).unionByName(ids(measurements)).unionByName(ids(hypotheses))
    complete = provenance.where(is_complete())
    n = scope.agg(F.count("*").alias("n")).scalar()
    records = complete.agg(F.count("*").alias("n")).scalar()
    covered = scope.join(complete.select("entity_id"), "entity_id", "left_semi").agg(F.count("*").alias("n")).scalar()
    share = lambda x: F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(1.0))
    return provenance.sparkSession.range(1).select(
        records.alias("complete_records"), n.alias("entities"), covered.alias("covered_entities"),
        share(records).alias("as_reference"), share(covered).alias("as_documented"),
    )


def coverage(provenance: DataFrame) -> DataFrame:
    return provenance.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("source_doi", F.lit("")) != "").alias("with_doi"),
        F.count_if("validated").alias("validated"),
    )


def with_sources(provenance: DataFrame, sources: DataFrame, keep_unlisted: bool = True) -> DataFrame:
    """One row per (record, source id) with the source's details; the record's DOI goes first."""
    explode = F.explode_outer if keep_unlisted else F.explode
    src = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("doi").alias("_doi"), "url", "source_type"
    )
    listed = provenance.withColumn("source_id", explode("source_ids"))
    return salted_lookup(listed, src, "source_id").withColumn(
        "source_name", F.coalesce("source_name", F.when(F.col("source_id").isNotNull(), "Unknown"))
    ).withColumn("source_doi", F.coalesce(F.nullif("source_doi", F.lit("")), "_doi")).drop("_doi")


def explain_entities(typed: DataFrame, provenance: DataFrame, sources: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, entity_type, name) of each entity with its records and their sources, if any."""
    if ids is not None:
        typed = typed.join(ids.select("id"), "id", "left_semi")
        provenance = provenance.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    records = with_sources(provenance, sources).select(
        F.col("entity_id").alias("id"), "source_name", "source_doi", "source_row_id", "extraction_method", "confidence", "validated"
    )
    return typed.select("id", "entity_type", "name").join(records, "id", "left")


def explain_relations(edges: DataFrame, molecules: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Why an edge exists: equal keys, literature, or the hypothesis it came from; further columns of edges are kept."""
    further = [c for c in edges.columns if c not in SPO]
    keys = molecules.select(F.col("id").alias("_id"), F.col("smiles").alias("_key"))
    s = keys.select(F.col("_id").alias("subject"), F.col("_key").alias("_s"))
    o = keys.select(F.col("_id").alias("object"), F.col("_key").alias("_o"))
    mined = ["increases", "decreases", "coOccursWith"]
    first = hypotheses.where(F.col("predicate").isin(mined)).groupBy(*SPO).agg(
        F.min_by(F.struct("source", "confidence"), F.col("id")).alias("_h")
    )
    ends = salted_lookups(edges, [(s, "subject"), (o, "object")])
    joined = ends.join(first, SPO, "left")
    p = F.col("predicate")
    same = (p == "sameAs") & (F.col("_s") == F.col("_o"))
    basis = F.when(same, "SMILES_matching").when(p == "decomposesTo", "literature_knowledge").when(
        p.isin(mined), F.col("_h.source"))
    why = (
        F.when(same, F.concat(F.lit("Both entities have identical SMILES: "), F.col("_s")))
        .when(p == "decomposesTo", "Decomposition pathway from electrolyte chemistry literature")
    )
    methods = vocab.dimension(edges.sparkSession, vocab.RELATION_BASIS, ["predicate", "kind_of_basis"])
    return joined.join(F.broadcast(methods), "predicate", "left").select(
        *SPO, basis.alias("inference_method"), F.col("_h.confidence").alias("confidence"), why.alias("explanation"), "kind_of_basis", *further
    )


def trace_measurements(measurements: DataFrame, owners: DataFrame, provenance: DataFrame) -> DataFrame:
    """Measurement -> first owning formulation -> dataset and row of its first record.

    ``owners(measurement_id, formulation_id, formulation_name)``.
    """
    owner = owners.groupBy(F.col("measurement_id").alias("id")).agg(
        F.min_by(F.struct("formulation_id", "formulation_name"), F.col("formulation_id")).alias("_f")
    )
    record = provenance.groupBy(F.col("entity_id").alias("formulation_id")).agg(
        F.min_by(F.struct("source_doi", "source_row_id"), F.col("id")).alias("_p")
    )
    traced = measurements.join(owner, "id", "left").withColumn("formulation_id", F.col("_f.formulation_id"))
    return salted_lookup(traced, record, "formulation_id").select(
        "id", "property_type", "value", "formulation_id", F.col("_f.formulation_name").alias("formulation_name"),
        F.col("_p.source_doi").alias("source_dataset"), F.col("_p.source_row_id").alias("original_row"),
    )


def provenance_with_measurements(
    entity_links: DataFrame, measurements: DataFrame, provenance: DataFrame, sources: DataFrame, first: int = 5
) -> DataFrame:
    """Records of each entity and the first record of its first five measurements.

    ``entity_links(entity_id, measurement_id)``; measurements are taken in id order.
    """
    entities = entity_links.select("entity_id").distinct()
    own = provenance.join(entities, "entity_id", "left_semi").withColumn("owner_id", F.col("entity_id"))
    order = Window.partitionBy("entity_id").orderBy("measurement_id")
    some = entity_links.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= first).drop("_rn")
    some = some.withColumnsRenamed({"entity_id": "owner_id", "measurement_id": "entity_id"})
    columns = [c for c in provenance.columns if c != "entity_id"]
    once = provenance.groupBy("entity_id").agg(F.min_by(F.struct(*columns), F.col("id")).alias("_r")).select("entity_id", "_r.*")
    typed = measurements.select(F.col("id").alias("entity_id"), "property_type")
    label = F.concat(F.lit("Measurement ("), F.coalesce("property_type", F.lit("unknown")), F.lit(")"))
    measured = (
        some.join(once, "entity_id").join(typed, "entity_id", "left")
        .withColumn("entity_type", label).drop("property_type")
    )
    return with_sources(own.unionByName(measured), sources, keep_unlisted=False)


def grouped_by_source(records: DataFrame) -> DataFrame:
    """Per owner and source: a DOI, the row count and the number of entity types."""
    return records.groupBy("owner_id", "source_name").agg(
        F.min("source_doi").alias("doi"), F.count("source_row_id").alias("rows"),
        F.count_distinct("entity_type").alias("types"),
    )


def provenance_rows(
    entities: DataFrame, entity_type: str, source_id: str, doi: str | None, row: Column,
    method: str = "structured_ingestion", confidence: Column | float = 1.0, agent_id: str | None = None,
) -> DataFrame:
    """One record per created entity; the id depends only on the entity and its source row."""
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    eid = F.col("id").cast("string")
    return entities.select(
        F.concat(F.lit("prov-"), scalar.short_md5(16, eid, F.lit(source_id), row.cast("string"))).alias("id"),
        eid.alias("entity_id"), F.lit(entity_type).alias("entity_type"), F.array(F.lit(source_id)).alias("source_ids"),
        F.lit(doi).cast("string").alias("source_doi"), row.cast("string").alias("source_row_id"),
        F.lit(None).cast("string").alias("activity_id"), F.lit(method).alias("extraction_method"),
        F.lit(agent_id).cast("string").alias("agent_id"), conf.alias("confidence"), F.lit(False).alias("validated"),
    )


def source_dimension(spark) -> DataFrame:
    """The ingested datasets as source rows."""
    return vocab.dimension(spark, vocab.DATASETS, ["id", "source_type", "name", "doi"])


def agent_dimension(spark, version: str = "1.0.0") -> DataFrame:
    """One software agent per dataset reader."""
    return source_dimension(spark).select(
        F.concat(F.lit("agent:"), "id").alias("id"), F.concat(F.col("id"), F.lit(" reader")).alias("name"),
        F.lit("software").alias("agent_type"), F.lit(version).alias("version"),
        F.concat(F.lit("Automated ingestor for "), "name").alias("description"),
    )
