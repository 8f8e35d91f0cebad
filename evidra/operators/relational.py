"""Relational core of the evidence graph.

``relations(subject, predicate, object[, provenance_id])`` is a bag: parallel edges stay.
Triples are its distinct (subject, predicate, object).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidra import vocab
from evidra.functions import scalar
from evidra.operators.skew import salted_lookup, salted_lookups

SPO = ["subject", "predicate", "object"]


def edge_match(relations: DataFrame, subject=None, predicate=None, object=None) -> DataFrame:
    """Edges matching every given end or predicate; works on the bag and on triples alike."""
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object)):
        if value is not None:
            relations = relations.where(F.col(name) == value)
    return relations


def triples(relations: DataFrame) -> DataFrame:
    return relations.select(*SPO).distinct()


def vocabulary_sizes(triple_set: DataFrame) -> DataFrame:
    """(position, n_distinct) for subject, predicate and object, plus the triple count."""
    sizes = [
        triple_set.select(p).distinct().agg(F.count("*").alias("n")).select(F.lit(p).alias("position"), "n")
        for p in SPO
    ]
    total = triple_set.agg(F.count("*").alias("n")).select(F.lit("triple").alias("position"), "n")
    return reduce(DataFrame.unionByName, sizes, total)


def add_triples(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.select(*SPO).unionByName(new.select(*SPO)).distinct()


def remove_triples(base: DataFrame, gone: DataFrame) -> DataFrame:
    return base.join(gone.select(*SPO), SPO, "left_anti")


def upsert(base: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write per key wins, by ``seq``, ties by the row's values. The rank limit is also applied
    before the shuffle."""
    both = base.unionByName(new, allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.desc(seq), F.to_json(F.struct(*both.columns)))
    return (
        both
        .withColumn("_rn", F.row_number().over(latest))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def entity_lookup(stores: Sequence[tuple[str, DataFrame]], ids: DataFrame | None = None) -> DataFrame:
    """(id, entity_type, name): the first store in the given order that knows an id."""
    parts = [
        df.select(F.col("id").cast("string").alias("id"), F.lit(kind).alias("entity_type"), "name", F.lit(i).alias("_rank"))
        for i, (kind, df) in enumerate(stores)
    ]
    union = reduce(DataFrame.unionByName, parts)
    if ids is not None:
        union = union.join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    best = F.min_by(F.struct("entity_type", "name"), F.col("_rank"))
    return union.groupBy("id").agg(best.alias("e")).select("id", "e.entity_type", "e.name")


def formulations_with_component(formulations: DataFrame, components: DataFrame, molecule_id) -> DataFrame:
    wanted = components.where(F.col("molecule_id") == molecule_id).select(F.col("formulation_id").alias("id"))
    return formulations.join(wanted, "id", "left_semi")


def components_of_type(components: DataFrame, component_type: str) -> DataFrame:
    return components.where(F.col("component_type") == component_type)


def measurements_in_range(
    measurements: DataFrame, property_type: str, min_value=None, max_value=None, temperature=None
) -> DataFrame:
    """Measurements of one property; bounds are inclusive, the temperature must match exactly."""
    out = measurements.where(F.col("property_type") == property_type)
    if min_value is not None:
        out = out.where(F.col("value") >= min_value)
    if max_value is not None:
        out = out.where(F.col("value") <= max_value)
    if temperature is not None:
        out = out.where(F.col("temperature") == temperature)
    return out


def formulations_by_property(formulations: DataFrame, measurements: DataFrame, property_type: str, **bounds) -> DataFrame:
    found = measurements_in_range(measurements, property_type, **bounds)
    return found.join(formulations.withColumnRenamed("id", "formulation_id"), "formulation_id")


def unified_entities(stores: Sequence[tuple[str, DataFrame]], infer_type_of: str = "molecules") -> DataFrame:
    """All stores as (id, name, smiles, type, store, synonyms); plain molecules get an inferred type."""
    parts = []
    for store, df in stores:
        name = F.coalesce("name", F.substring(F.col("id").cast("string"), 1, 12))
        smiles = F.coalesce("smiles", F.lit(""))
        kind = scalar.infer_molecule_type(name, smiles) if store == infer_type_of else F.lit(store)
        parts.append(
            df.select(
                F.col("id").cast("string").alias("id"), name.alias("name"), smiles.alias("smiles"),
                kind.alias("type"), F.lit(store).alias("store"), "synonyms",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def matches_text(query: str) -> Column:
    q = query.lower()
    found = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return (
        found(F.col("name")) | found(F.col("smiles")) | found(F.col("type"))
        | F.coalesce(F.exists("synonyms", found), F.lit(False))
    )


def search_entities(entities: DataFrame, query: str = "", types: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """Case-insensitive substring search, sorted by name (then id), cut at ``limit``."""
    if types:
        entities = entities.where(F.col("type").isin(list(types)))
    if query:
        entities = entities.where(matches_text(query))
    return entities.orderBy("name", "id").limit(limit)


def search_by_label(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Search over ``name (type)`` labels."""
    label = F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"))
    return (
        entities.withColumn("label", label)
        .where(F.lower("label").contains(query.lower()))
        .orderBy("label", "id").limit(limit)
    )


def incident_edges(
    relations: DataFrame, entities: DataFrame, seeds: DataFrame,
    predicates: Sequence[str] | None = tuple(vocab.MOLECULE_PREDICATES),
) -> DataFrame:
    """Edges touching the ``seeds(id)``, seen from each seed; a self-loop is outgoing only.

    The other end must be a known entity and brings its name and type along.
    """
    edges = relations.select(*SPO)
    if predicates is not None:
        edges = edges.where(F.col("predicate").isin(list(predicates)))
    views = F.array(
        F.struct(F.lit("outgoing").alias("direction"), F.col("subject").alias("id"), F.col("object").alias("other_id")),
        F.struct(F.lit("incoming").alias("direction"), F.col("object").alias("id"), F.col("subject").alias("other_id")),
    )
    seen = edges.select("predicate", F.inline(views)).where(
        (F.col("direction") == "outgoing") | (F.col("id") != F.col("other_id"))
    )
    other = entities.select(
        F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type")
    )
    touching = seen.join(seeds.select("id").distinct(), "id", "left_semi")
    return salted_lookup(touching, other, "other_id", "inner")


def incident_sample(incident: DataFrame, per_entity: int = 10) -> DataFrame:
    """The first edges of each entity, in (direction, predicate, other) order."""
    order = Window.partitionBy("id").orderBy(F.desc("direction"), "predicate", "other_id")
    return incident.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_entity)


def neighbours(relations: DataFrame, entities: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct neighbours outside the seed set; a cap is applied in id order."""
    out = (
        incident_edges(relations, entities, seeds)
        .select(F.col("other_id").alias("id"), F.col("other_name").alias("name"), F.col("other_type").alias("type"))
        .distinct()
        .join(seeds.select("id"), "id", "left_anti")
    )
    return out if limit is None else out.orderBy("id").limit(limit)


def alias_table(entities: DataFrame) -> DataFrame:
    """(alias, id): ids, names and synonyms, the smallest id winning a shared alias."""
    names = F.array_union(
        F.array(F.col("id"), F.col("name")), F.coalesce("synonyms", F.array().cast("array<string>"))
    )
    exploded = entities.select("id", F.explode(names).alias("alias")).where(F.col("alias").isNotNull())
    own = F.struct((F.col("alias") != F.col("id")).alias("other"), "id")
    return exploded.groupBy("alias").agg(F.min_by("id", own).alias("id"))


def induced_subgraph(relations: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes, whichever alias their ends are written with."""
    alias = alias_table(entities)
    inside = alias.join(nodes.select("id"), "id", "left_semi")
    s = inside.select(F.col("alias").alias("subject"), F.col("id").alias("source"))
    o = inside.select(F.col("alias").alias("object"), F.col("id").alias("target"))
    ends = salted_lookups(relations, [(s, "subject"), (o, "object")], "inner")
    return ends.select("source", "predicate", "target")


def measurements_of_entities(relations: DataFrame, measurements: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Measurements reached over hasMeasurement, per entity."""
    links = relations.where(F.col("predicate") == "hasMeasurement").select(
        F.col("subject").alias("entity_id"), F.col("object").alias("id")
    )
    if ids is not None:
        links = links.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return links.join(measurements, "id")


def relation_report(relations: DataFrame, names: DataFrame, predicate: str, listed: int = 100, shown: int = 5) -> DataFrame:
    """Sample edges of one predicate with names, next to the total and listed counts."""
    edges = edge_match(relations, predicate=predicate).select(*SPO)
    total = edges.agg(F.count("*").alias("n")).scalar()
    sample = edges.orderBy("subject", "object").limit(shown)
    s = names.select(F.col("id").alias("subject"), F.col("name").alias("subject_name"))
    o = names.select(F.col("id").alias("object"), F.col("name").alias("object_name"))
    short = lambda c: F.concat(F.substring(F.col(c), 1, 12), F.lit("..."))
    return (
        sample.join(s, "subject", "left").join(o, "object", "left")
        .withColumn("subject_name", F.coalesce("subject_name", short("subject")))
        .withColumn("object_name", F.coalesce("object_name", short("object")))
        .withColumn("total", total)
        .withColumn("listed", F.least(total, F.lit(listed).cast("bigint")))
    )


def constraint_violations(relations: DataFrame, entity_types: DataFrame) -> DataFrame:
    """Edges whose end has no type the predicate allows; ``entity_types(id, type)``, many per id.

    The types of an entity and those a predicate allows are bit sets, compared by AND.
    """
    spark = relations.sparkSession
    kinds = sorted({t for _, domain, allowed in vocab.RELATION_CONSTRAINTS for t in domain + allowed})
    bits = lambda names: sum(1 << kinds.index(n) for n in names)
    rules = spark.createDataFrame(
        [(p, bits(domain), bits(allowed)) for p, domain, allowed in vocab.RELATION_CONSTRAINTS],
        "predicate string, domain long, range long",
    )
    bit = F.coalesce(*[F.when(F.col("type") == k, F.lit(1 << i)) for i, k in enumerate(kinds)], F.lit(0)).cast("long")
    types = entity_types.groupBy("id").agg(F.bit_or(bit).alias("bits"))
    s = types.select(F.col("id").alias("subject"), F.col("bits").alias("_s"))
    o = types.select(F.col("id").alias("object"), F.col("bits").alias("_o"))
    ruled = relations.select(*SPO).join(F.broadcast(rules), "predicate")
    checked = salted_lookups(ruled, [(s, "subject"), (o, "object")])
    outside = lambda mine, allowed: F.coalesce(F.col(mine), F.lit(0)).bitwiseAND(F.col(allowed)) == 0
    return (
        checked.withColumn("bad_subject", outside("_s", "domain")).withColumn("bad_object", outside("_o", "range"))
        .where(F.col("bad_subject") | F.col("bad_object")).select(*SPO, "bad_subject", "bad_object")
    )


def component_edges(components: DataFrame, molecules: DataFrame) -> DataFrame:
    """One edge per component of a known molecule; its type picks the predicate."""
    predicate = F.coalesce(
        *[F.when(F.col("component_type") == t, p) for t, p in vocab.COMPONENT_PREDICATES.items()],
        F.lit("hasComponent"),
    )
    known = molecules.select(F.col("id").alias("molecule_id"))
    return components.join(known, "molecule_id", "left_semi").select(
        F.col("formulation_id").alias("subject"), predicate.alias("predicate"), F.col("molecule_id").alias("object")
    )


def without_existing(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates whose triple is not in the graph."""
    return candidates.join(triples(relations), SPO, "left_anti")
