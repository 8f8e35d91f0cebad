"""Resolving, merging and de-duplicating molecules.

``molecules(id, name, smiles, inchi, inchi_key, pubchem_cid, cas_number, molecular_weight,
synonyms)``. Identity is the canonical structure key; rows without one stay as they are. The
kept row of a group is chosen by an aggregate that combines map-side, and synonyms of a group
are a child table, so a group with a third of all rows is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidra.functions import scalar
from evidra.operators.relational import SPO
from evidra.operators.skew import salted_lookup, salted_lookups
from evidra.session import cut_lineage

MERGED_FIELDS = ["inchi", "inchi_key", "pubchem_cid", "cas_number", "molecular_weight"]


def name_rank(name: str = "name", id_: str = "id") -> Column:
    """Ascending order of preference: a real name, then a longer one, then the smaller id."""
    text = F.coalesce(F.col(name), F.lit(""))
    return F.struct(
        scalar.looks_like_structure(text).alias("structure_like"),
        (-F.length(text)).alias("shorter"),
        F.col(id_).alias("id"),
    )


def canonical(molecules: DataFrame, udf=None) -> DataFrame:
    return scalar.with_canonical_key(molecules, "smiles", "key", udf)


def duplicate_map(molecules: DataFrame, udf=None) -> DataFrame:
    """(old_id, new_id, key) for every molecule that loses its id to a better copy."""
    keyed = canonical(molecules, udf).where(F.col("key").isNotNull())
    keep = (
        keyed.groupBy("key")
        .agg(F.min_by("id", name_rank()).alias("new_id"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    mapped = salted_lookup(keyed.select(F.col("id").alias("old_id"), "key"), keep, "key", "inner")
    return mapped.where(F.col("old_id") != F.col("new_id")).select("old_id", "new_id", "key")


def merged_molecules(molecules: DataFrame, udf=None) -> DataFrame:
    """One row per molecule after merging: best name, first non-empty value of each field."""
    keyed = canonical(molecules, udf)
    group = F.coalesce(F.concat(F.lit("k:"), "key"), F.concat(F.lit("i:"), F.col("id").cast("string")))
    rank = name_rank()
    fields = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in MERGED_FIELDS]
    return (
        keyed.withColumn("_group", group)
        .groupBy("_group")
        .agg(
            F.min_by(F.struct("id", "name", "key"), rank).alias("_best"),
            *fields,
            F.count("*").alias("n_merged"),
        )
        .select("_best.id", "_best.name", F.col("_best.key").alias("smiles"), *MERGED_FIELDS, "n_merged")
    )


def merged_synonyms(molecules: DataFrame, udf=None) -> DataFrame:
    """(id, synonym) after merging: all synonyms, plus the names that were not kept."""
    mapping = cut_lineage(duplicate_map(molecules, udf).select(F.col("old_id").alias("id"), "new_id"))
    rows = molecules.select("id", "name", "synonyms").join(mapping, "id", "left")
    kept = F.coalesce("new_id", "id")
    words = F.array_compact(F.concat(
        F.coalesce("synonyms", F.array().cast("array<string>")), F.array(F.when(F.col("new_id").isNotNull(), F.col("name")))
    ))
    listed = rows.select(kept.alias("id"), F.explode(words).alias("synonym")).distinct()
    lost_name = mapping.select(F.col("new_id").alias("id")).distinct().join(
        molecules.select("id", F.col("name").alias("synonym")), "id"
    )
    # A losing copy may carry the kept name itself; that is not a synonym unless it was listed.
    own = molecules.select("id", F.explode("synonyms").alias("synonym"))
    own = own.join(mapping, "id", "left").select(F.coalesce("new_id", "id").alias("id"), "synonym").distinct()
    return listed.join(lost_name, ["id", "synonym"], "left_anti").unionByName(
        own.join(lost_name, ["id", "synonym"], "left_semi")
    )


def rewrite_edges(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends mapped to the kept ids, parallel edges kept, with a flag for changed rows."""
    s = mapping.select(F.col("old_id").alias("subject"), F.col("new_id").alias("_s"))
    o = mapping.select(F.col("old_id").alias("object"), F.col("new_id").alias("_o"))
    joined = salted_lookups(relations, [(s, "subject"), (o, "object")])
    return joined.select(
        F.coalesce("_s", "subject").alias("subject"), "predicate", F.coalesce("_o", "object").alias("object"),
        (F.col("_s").isNotNull() | F.col("_o").isNotNull()).alias("rewritten"),
    )


def compact_edges(rewritten: DataFrame) -> DataFrame:
    """Distinct edges without the sameAs self-loops that merging leaves behind."""
    loop = (F.col("predicate") == "sameAs") & (F.col("subject") == F.col("object"))
    return rewritten.where(~loop).select(*SPO).distinct()


def rewrite_components(components: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("old_id").alias("molecule_id"), F.col("new_id").alias("_new"))
    joined = salted_lookup(components, m, "molecule_id")
    return joined.withColumn("molecule_id", F.coalesce("_new", "molecule_id")).drop("_new")


def dedup_stats(molecules: DataFrame, relations: DataFrame, udf=None) -> DataFrame:
    """Before/after counts of one de-duplication as (metric, value)."""
    mapping = cut_lineage(duplicate_map(molecules, udf))
    merged = mapping.agg(F.count("*").alias("n")).scalar()
    before = molecules.agg(F.count("*").alias("n")).scalar()
    changed = rewrite_edges(relations, mapping).agg(F.count_if("rewritten").alias("n")).scalar()
    base = molecules.sparkSession.range(1)
    return base.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.alias("value"))
        for name, value in (
            ("molecules_before", before), ("duplicates_found", merged), ("molecules_merged", merged),
            ("relations_updated", changed), ("molecules_after", before - merged),
        )
    ])))


def resolve_by_key(incoming: DataFrame, molecules: DataFrame, udf=None) -> DataFrame:
    """Each row's molecule id: the existing one of its key, else a new md5 id of the key."""
    existing = canonical(molecules, udf).where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").cast("string").alias("existing_id")
    )
    keyed = canonical(incoming, udf)
    joined = salted_lookup(keyed, existing, "key")
    new_id = F.when(F.col("key").isNotNull(), F.concat(F.lit("mol-"), F.substring(F.md5("key"), 1, 12)))
    return joined.withColumn("molecule_id", F.coalesce("existing_id", new_id)).withColumn(
        "matched", F.col("existing_id").isNotNull()
    ).drop("existing_id")


def resolve_by_key_or_name(incoming: DataFrame, molecules: DataFrame) -> DataFrame:
    """By structure key, then by normalised name, else a new id of the normalised name."""
    known = canonical(molecules)
    by_key = known.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").cast("string").alias("_by_key"))
    by_name = (
        known.withColumn("norm_name", scalar.normalize_name(F.col("name")))
        .groupBy("norm_name").agg(F.min("id").cast("string").alias("_by_name"))
    )
    rows = canonical(incoming).withColumn("norm_name", scalar.normalize_name(F.col("name")))
    joined = salted_lookups(rows, [(by_key, "key"), (by_name, "norm_name")])
    new_id = F.concat(F.lit("mol-"), F.substring(F.md5("norm_name"), 1, 12))
    how = F.when(F.col("_by_key").isNotNull(), "key").when(F.col("_by_name").isNotNull(), "name").otherwise("new")
    return joined.withColumn("matched_by", how).withColumn(
        "molecule_id", F.coalesce("_by_key", "_by_name", new_id)
    ).drop("_by_key", "_by_name")


def resolve_with_variations(incoming: DataFrame, molecules: DataFrame) -> DataFrame:
    """Exact trimmed key first, then the key without explicit double bonds."""
    index = canonical(molecules).where(F.col("key").isNotNull()).groupBy("key").agg(F.max("id").cast("string").alias("_id"))
    keyed = canonical(incoming).withColumn("key2", F.replace("key", F.lit("="), F.lit("")))
    exact = index.select("key", F.col("_id").alias("_exact"))
    loose = index.select(F.col("key").alias("key2"), F.col("_id").alias("_loose"))
    second = salted_lookups(keyed, [(exact, "key"), (loose, "key2")])
    return second.withColumn("molecule_id", F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "key2")


def same_as_star(molecules: DataFrame) -> DataFrame:
    """sameAs edges of equal keys, both directions, from each member to the group's first id.

    The star has the same closure as all pairs with 2(n-1) edges instead of n(n-1).
    """
    keyed = canonical(molecules).where(F.col("key").isNotNull()).select("id", "key")
    hub = keyed.groupBy("key").agg(F.min("id").alias("hub"))
    arms = salted_lookup(keyed, hub, "key", "inner").where(F.col("id") != F.col("hub"))
    return arms.select(F.inline(F.array(
        F.struct(F.col("hub").alias("subject"), F.lit("sameAs").alias("predicate"), F.col("id").alias("object")),
        F.struct(F.col("id").alias("subject"), F.lit("sameAs").alias("predicate"), F.col("hub").alias("object")),
    )))


def same_as_of(seeds: DataFrame, molecules: DataFrame) -> DataFrame:
    """For the asked ``seeds(id)``: every other molecule with an equal key."""
    keyed = canonical(molecules).where(F.col("key").isNotNull()).select("id", "key")
    asked = keyed.join(seeds.select("id"), "id", "left_semi").select(F.col("id").alias("subject"), "key")
    return keyed.withColumnRenamed("id", "object").join(asked, "key").where(F.col("subject") != F.col("object")).select(
        "subject", F.lit("sameAs").alias("predicate"), "object"
    )


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key by ``order``, ties by the row's values; combines map-side."""
    others = [c for c in df.columns if c != key]
    row = F.struct(*others)
    best = F.min_by(row, F.struct(order, F.to_json(row))).alias("_first")
    return df.groupBy(key).agg(best).select(key, "_first.*")


def composition_groups(components: DataFrame) -> DataFrame:
    """(fingerprint, first_formulation, formulations): formulations of equal composition.

    Amounts are rounded to four decimals. The fingerprint combines entry hashes by sums that
    do not depend on order, so it needs no list of a formulation's components.
    """
    entry = F.concat_ws(":", F.col("molecule_id").cast("string"), scalar.fixed4(F.col("amount")))
    h1 = F.xxhash64(entry).cast("decimal(38,0)")
    h2 = F.xxhash64(F.concat(entry, F.lit("#"))).cast("decimal(38,0)")
    prints = components.groupBy("formulation_id").agg(
        F.count("*").alias("n"), F.sum(h1).alias("s1"), F.sum(h2).alias("s2")
    )
    key = F.substring(F.md5(F.concat_ws("|", "n", "s1", "s2")), 1, 16)
    return prints.withColumn("fingerprint", key).groupBy("fingerprint").agg(
        F.min("formulation_id").alias("first_formulation"), F.count("*").alias("formulations")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected ``edges(a, b)`` graph; the component is its smallest id.

    Alternates two re-wirings until every edge points from a node to its component's root:
    first each node's larger neighbours are hung under its smallest neighbour, then each
    node's smaller neighbours are. Every round shuffles edges and one minimum per node.
    """
    current = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    current = cut_lineage(current)
    nodes = current.select(F.col("a").alias("id")).unionByName(current.select(F.col("b").alias("id"))).distinct()

    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = None
    while True:  # rounds follow the logarithm of the longest chain
        sym = both_ways(current)
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = sym.where(F.col("b") > F.col("a")).join(low, "a")  # hubs: AQE splits the edge side
        hung = larger.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        smaller = hung.join(low, "a")
        rewired = smaller.select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        ))).where(F.col("a") != F.col("b")).distinct()
        current = cut_lineage(rewired)
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
