"""Fill molecules from a registry snapshot table.

``registry(registry_id, smiles, name, inchi, inchi_key, cas_number, molecular_weight,
synonyms)``: matched by registry id, then structure, then name; existing values stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidra.operators.identity import MERGED_FIELDS
from evidra.operators.skew import salted_lookups

def match_registry(molecules: DataFrame, registry: DataFrame) -> DataFrame:
    """Molecules with the matched registry row ``r`` and ``matched_by``."""
    payload = F.struct(*[c for c in registry.columns])
    routes = [
        ("registry id", "pubchem_cid", "registry_id"),
        ("structure", "_smiles", "smiles"),
        ("name", "_name", "name"),
    ]
    out = molecules.withColumn("_smiles", F.trim("smiles")).withColumn("_name", F.lower(F.trim("name")))
    keyed = registry.withColumn("smiles", F.trim("smiles"))
    sides = []
    for i, (_, left, right) in enumerate(routes):
        key = F.lower(F.trim(right)) if right == "name" else F.col(right)
        side = keyed.select(key.alias(left), payload.alias("_p"), F.col("registry_id").alias("_rid")).where(
            F.col(left).isNotNull() & (F.col(left).cast("string") != "")
        )
        sides.append((side.groupBy(left).agg(F.min_by("_p", "_rid").alias(f"_r{i}")), left))
    out = salted_lookups(out, sides)
    by = F.coalesce(*[F.when(F.col(f"_r{i}").isNotNull(), r[0]) for i, r in enumerate(routes)])
    return out.withColumn("r", F.coalesce("_r0", "_r1", "_r2")).withColumn("matched_by", by).drop(
        "_r0", "_r1", "_r2", "_smiles", "_name"
    )


def enrich(molecules: DataFrame, registry: DataFrame, new_synonyms: int | None = None) -> DataFrame:
    """Missing identifiers filled and the registry's synonyms appended, all or the first ``new_synonyms``."""
    matched = match_registry(molecules, registry)
    fills = {
        "pubchem_cid": "registry_id",
        **{c: c for c in MERGED_FIELDS if c != "pubchem_cid"},
    }
    none = F.array().cast("array<string>")
    found = F.col("r.synonyms") if new_synonyms is None else F.slice("r.synonyms", 1, new_synonyms)
    synonyms = F.array_union(F.coalesce("synonyms", none), F.coalesce(found, none))
    return matched.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"r.{source}")) for c, source in fills.items()}
    ).withColumn("synonyms", synonyms).drop("r")


def enrichment_provenance(enriched: DataFrame, source: str) -> DataFrame:
    """One provenance row per molecule that was looked up."""
    used = F.when(F.col("matched_by").isNotNull(), F.array(F.lit(source))).otherwise(F.array().cast("array<string>"))
    return enriched.select(
        F.concat(F.lit("prov-"), F.md5(F.concat_ws(":", F.lit("enrich"), F.col("id").cast("string")))).alias("id"),
        F.col("id").cast("string").alias("entity_id"), F.lit("Molecule").alias("entity_type"),
        used.alias("source_ids"), F.lit("external_kg_enrichment").alias("extraction_method"),
        F.lit(1.0).alias("confidence"),
    )


def fold_registry(bindings: DataFrame, key: str, scalars: list[str], order: str) -> DataFrame:
    """Many result rows per identifier to one: the first non-null value of each scalar field."""
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    return bindings.groupBy(key).agg(*picks)


def fold_registry_sets(bindings: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, value): the distinct values of multi-valued fields, as a child table."""
    return (
        bindings.select(key, *columns).unpivot([key], columns, "field", "value")
        .where(F.col("value").isNotNull()).distinct()
    )
