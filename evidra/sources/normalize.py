"""Source rows to graph tables.

Two row shapes cover all sources. A *formulation row* holds its components as a small array
(bounded by the source's columns) and one measured value. A *molecule row* holds a structure
and one property value. Both are fanned out by projections; rejected rows keep their reason.
Ids are hashes of content, never random, so a recomputed task writes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidra import vocab
from evidra.functions import scalar
from evidra.operators.provenance import provenance_rows


@dataclass(frozen=True)
class SourceTables:
    molecules: DataFrame
    molecule_roles: DataFrame
    formulations: DataFrame | None
    components: DataFrame | None
    measurements: DataFrame
    relations: DataFrame
    provenance: DataFrame
    rejects: DataFrame


def molecule_id(structure: Column) -> Column:
    return F.concat(F.lit("mol-"), F.substring(F.md5(scalar.canonical_key(structure)), 1, 12))


def component(structure: Column, name: Column, kind: str, amount: Column, unit: Column) -> Column:
    return F.struct(
        scalar.canonical_key(structure).alias("structure"), name.alias("name"), F.lit(kind).alias("component_type"),
        amount.cast("double").alias("amount"), unit.alias("unit"),
    )


def present(components: Column) -> Column:
    """Components with a structure and a positive amount."""
    return F.filter(components, lambda c: c["structure"].isNotNull() & F.coalesce(c["amount"] > 0, F.lit(False)))


def _measurement_id(source: str, *parts: Column) -> Column:
    return F.concat(F.lit("meas-"), scalar.short_md5(16, F.lit(source), *[p.cast("string") for p in parts]))


def _measures(measurements: DataFrame) -> DataFrame:
    return measurements.select(
        F.col("owner_id").alias("subject"), F.lit("hasMeasurement").alias("predicate"), F.col("id").alias("object")
    ).unionByName(measurements.select(
        F.col("id").alias("subject"), F.lit("measuresProperty").alias("predicate"),
        scalar.property_entity_id(F.col("property_type")).alias("object"),
    ))


def formulation_tables(
    rows: DataFrame, source: str, doi: str | None, property_type: str, unit: str,
    extraction: str = "structured_ingestion", extra_molecules: DataFrame | None = None,
) -> SourceTables:
    """Tables of formulation rows (row_id, comps, value, temperature, reject_reason, value_reject).

    Equal compositions are one formulation, made from its first row. A row with a
    ``reject_reason`` makes nothing; one with a ``value_reject`` makes its formulation only.
    """
    entry = lambda c: F.concat_ws(":", c["component_type"], c["structure"], scalar.fixed4(c["amount"]))
    kept = rows.where(F.col("reject_reason").isNull()).withColumn(
        "formulation_id", F.concat(F.lit("form-"), scalar.composition_key(F.transform("comps", entry)))
    )
    first = kept.groupBy("formulation_id").agg(
        F.min_by(F.struct("row_id", "comps", "label"), F.col("row_id")).alias("f")
    ).select("formulation_id", "f.*")
    listed = first.select("formulation_id", F.posexplode("comps").alias("position", "c")).select(
        "formulation_id", molecule_id(F.col("c.structure")).alias("molecule_id"), "c.component_type", "c.amount", "c.unit",
        "position", F.col("c.structure").alias("smiles"), F.col("c.name").alias("name"),
    )
    mentioned = listed.select(F.col("molecule_id").alias("id"), "name", "smiles", F.col("component_type").alias("role"))
    if extra_molecules is not None:
        mentioned = mentioned.unionByName(extra_molecules)
    measured = kept.where(F.col("value_reject").isNull()).select(
        _measurement_id(source, F.col("row_id"), F.lit(property_type)).alias("id"),
        F.col("formulation_id").alias("owner_id"), F.lit(property_type).alias("property_type"), "value",
        F.lit(unit).alias("unit"), F.col("temperature").cast("double").alias("temperature"),
        F.col("row_id").cast("string").alias("source_row_id"),
    )
    formulations = first.select(
        F.col("formulation_id").alias("id"), F.coalesce("label", "formulation_id").alias("name"),
        F.lit(source).alias("source_id"), F.col("row_id").cast("string").alias("source_row_id"),
    )
    predicate = F.coalesce(*[F.when(F.col("component_type") == t, p) for t, p in vocab.COMPONENT_PREDICATES.items()])
    edges = listed.select(F.col("formulation_id").alias("subject"), predicate.alias("predicate"), F.col("molecule_id").alias("object"))
    prov = provenance_rows(formulations, "ElectrolyteFormulation", source, doi, F.col("source_row_id"), extraction).unionByName(
        provenance_rows(measured, "PropertyMeasurement", source, doi, F.col("source_row_id"), extraction))
    return _tables(mentioned, formulations, listed.drop("smiles", "name"), measured, edges.unionByName(_measures(measured)), prov, rows)


def molecule_tables(
    rows: DataFrame, source: str, doi: str | None, extraction: str = "structured_ingestion",
    confidence: float = 1.0, record_doi: bool = False,
) -> SourceTables:
    """Tables of molecule rows (row_id, smiles, name, role, property_type, value, unit, reject_reason).

    ``molecule_id`` may be given for molecules without a structure. Rows with a
    ``value_reject`` keep their molecule.
    """
    if "molecule_id" not in rows.columns:
        rows = rows.withColumn("molecule_id", molecule_id(F.col("smiles")))
    kept = rows.where(F.col("reject_reason").isNull())
    mentioned = kept.select(F.col("molecule_id").alias("id"), "name", scalar.canonical_key(F.col("smiles")).alias("smiles"), "role")
    measured = kept.where(F.col("value_reject").isNull()).select(
        _measurement_id(source, F.col("row_id"), F.col("property_type")).alias("id"), F.col("molecule_id").alias("owner_id"),
        "property_type", "value", "unit", F.lit(None).cast("double").alias("temperature"),
        F.col("row_id").cast("string").alias("source_row_id"),
        *([F.col("doi").alias("record_doi")] if record_doi else []),
    )
    prov = provenance_rows(measured, "PropertyMeasurement", source, doi, F.col("source_row_id"), extraction, confidence)
    if record_doi:
        own = measured.select(F.col("id").alias("entity_id"), "record_doi")
        prov = prov.join(own, "entity_id").withColumn("source_doi", F.col("record_doi")).withColumn(
            "source_ids", F.array(F.concat(F.lit("doi:"), "record_doi"))).drop("record_doi")
        measured = measured.drop("record_doi")
    return _tables(mentioned, None, None, measured, _measures(measured), prov, rows)


def _tables(mentioned, formulations, components, measured, relations, provenance, rows) -> SourceTables:
    # The smallest name is a deterministic choice among spellings of one structure.
    molecules = mentioned.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("name").alias("name"), F.min("smiles").alias("smiles"))
    roles = mentioned.where(F.col("id").isNotNull()).select(F.col("id").alias("molecule_id"), "role").distinct()
    reason = F.coalesce("reject_reason", "value_reject")
    rejects = rows.where(reason.isNotNull()).select("row_id", reason.alias("reject_reason"))
    return SourceTables(molecules, roles, formulations, components, measured, relations, provenance, rejects)


def _place(df: DataFrame) -> Column:
    """What says which of two rows comes first: the place in the scan where a reader gives it."""
    return F.col("row_no") if "row_no" in df.columns else F.col("row_id")


def _num(df: DataFrame, name: str) -> Column:
    return scalar.lenient_double(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("double")


def _text(df: DataFrame, name: str) -> Column:
    return scalar.canonical_key(F.col(f"`{name}`").cast("string")) if name in df.columns else F.lit(None).cast("string")


def _first_present(df: DataFrame, names: list[str]) -> Column:
    found = [n for n in names if n in df.columns]
    return _num(df, found[0]) if found else F.lit(None).cast("double")


def composition_rows(raw: DataFrame) -> DataFrame:
    """Masses per row. Symbol and unit lines have no number in any mass column and drop out."""
    rename = {"LiPF_6": "m_LiPF6", "EC": "m_EC", "PC": "m_PC", "EMC": "m_EMC", "EIS_conductivity": "conductivity"}
    if "LiPF_6" in raw.columns:
        raw = raw.withColumnsRenamed({k: v for k, v in rename.items() if k in raw.columns})
    comps, any_mass = [], F.lit(False)
    for abbr, name, smiles, _, _, _, role in vocab.rows(vocab.COMPOSITION_MOLECULES):
        column = f"m_{abbr}" if f"m_{abbr}" in raw.columns else abbr
        if abbr == "DMC" or column not in raw.columns:
            continue
        comps.append(component(F.lit(smiles), F.lit(name), role, _num(raw, column), F.lit("g")))
        any_mass = any_mass | _num(raw, column).isNotNull()
    value = _first_present(raw, ["conductivity", "Conductivity", "sigma", "ionic_conductivity"])
    temperature = _first_present(raw, ["temperature", "Temperature", "T", "temp"])
    return raw.select(
        "row_id", present(F.array(*comps)).alias("comps"),
        F.concat(F.lit("EC-PC-EMC-LiPF6-"), F.col("row_id").cast("string")).alias("label"),
        value.alias("value"), scalar.default_temperature(temperature).alias("temperature"),
        F.when(~any_mass, "no_masses").alias("reject_reason"), F.when(value.isNull(), "no_value").alias("value_reject"),
    )


def atlas_rows(raw: DataFrame) -> DataFrame:
    """Solvent fractions, salt and concentration; an unknown salt or no known solvent rejects."""
    structures = dict(vocab.rows(vocab.ATLAS_STRUCTURES))
    names = dict(vocab.rows(vocab.COMPOUND_NAMES))
    lookup = F.create_map(*[F.lit(x) for pair in structures.items() for x in pair])
    full = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    columns = [c for c in vocab.ATLAS_SOLVENTS if c in raw.columns and c in structures]
    solvents = F.array(*[
        component(F.lit(structures[c]), F.lit(names.get(c, c)), "solvent", _num(raw, c), F.lit("weight_fraction")) for c in columns
    ])
    used = F.filter(
        F.array(*[F.when(_num(raw, c) > 0, F.lit(c)) for c in columns]), lambda x: x.isNotNull()
    )
    salt = F.trim("salt")
    salt_structure = F.try_element_at(lookup, salt)
    unit = scalar.concentration_unit(F.col("`c units`") if "c units" in raw.columns else F.lit(None).cast("string"))
    # The salt always belongs to the formulation, whatever its concentration.
    salt_entry = F.array(component(salt_structure, F.coalesce(F.try_element_at(full, salt), salt), "salt", _num(raw, "c"), unit))
    value = _num(raw, "k")
    return raw.select(
        "row_id", F.concat(salt_entry, present(solvents)).alias("comps"),
        scalar.composition_name(used, salt, F.col("row_id")).alias("label"),
        value.alias("value"), scalar.celsius(_num(raw, "T")).alias("temperature"),
        F.when(salt_structure.isNull(), "unknown_salt").when(F.size(used) == 0, "no_solvent").alias("reject_reason"),
        F.when(value.isNull(), "no_value").alias("value_reject"),
    )


def _numbered_group(raw: DataFrame, smiles: str, ratio: str, count: int, kind: str, unit: str) -> Column:
    return F.array(*[
        component(_text(raw, smiles.format(i)), scalar.shorten(_text(raw, smiles.format(i))), kind, _num(raw, ratio.format(i)), F.lit(unit))
        for i in range(1, count + 1)
    ])


def experimental_conductivity_rows(raw: DataFrame) -> DataFrame:
    solvents = present(_numbered_group(raw, "solv_{}_sm", "solv_ratio_{}", 4, "solvent", "weight_fraction"))
    salt = _text(raw, "salt_sm")
    conc = F.coalesce(_num(raw, "conc_salt"), F.lit(1.0))
    comps = F.concat(F.array(component(salt, scalar.shorten(salt), "salt", conc, F.lit("m"))), solvents)
    value = _num(raw, "conductivity")
    return raw.select(
        "row_id", comps.alias("comps"), F.lit(None).cast("string").alias("label"),
        scalar.ms_to_s_per_cm(value).alias("value"), scalar.default_temperature(_num(raw, "temperature")).alias("temperature"),
        F.when((F.size(solvents) == 0) | salt.isNull(), "incomplete").alias("reject_reason"),
        F.when(value.isNull() | (value <= 0), "no_value").alias("value_reject"),
    )


def efficiency_rows(raw: DataFrame) -> DataFrame:
    """The first present salt counts; additives are molecules but not components."""
    solvents = present(_numbered_group(raw, "solvent_{}_smiles", "solv_{}_ratio", 3, "solvent", "weight_fraction"))
    salts = F.slice(present(_numbered_group(raw, "salt_{}_smiles", "salt_{}_conc", 2, "salt", "m")), 1, 1)
    value = _num(raw, "CE")
    return raw.select(
        "row_id", F.concat(salts, solvents).alias("comps"), F.lit(None).cast("string").alias("label"),
        value.alias("value"), F.lit(None).cast("double").alias("temperature"),
        F.when((F.size(solvents) == 0) | (F.size(salts) == 0), "incomplete").alias("reject_reason"),
        F.when(value.isNull(), "no_value").alias("value_reject"),
        _text(raw, "additive_smiles").alias("additive"),
    )


def efficiency_tables(raw: DataFrame, source: str = "experimental") -> SourceTables:
    rows = efficiency_rows(raw)
    additives = rows.where(F.col("additive").isNotNull()).select(
        molecule_id(F.col("additive")).alias("id"), scalar.shorten(F.col("additive")).alias("name"),
        F.col("additive").alias("smiles"), F.lit("additive").alias("role"))
    return formulation_tables(rows, source, _doi(source), "coulombic_efficiency", "dimensionless", "structured_dataset", additives)


def ionization_rows(raw: DataFrame) -> DataFrame:
    smiles, value = _text(raw, "smiles"), _num(raw, "IE")
    return raw.select(
        "row_id", smiles.alias("smiles"), scalar.shorten(smiles).alias("name"), F.lit("solvent").alias("role"),
        F.lit("ionization_energy").alias("property_type"), value.alias("value"), F.lit("eV").alias("unit"),
        F.when(smiles.isNull() | value.isNull(), "incomplete").alias("reject_reason"), F.lit(None).cast("string").alias("value_reject"),
    )


def curated_rows(entries: DataFrame) -> DataFrame:
    """One row per (molecule, known property with a value); others are counted as rejects."""
    names = dict(vocab.rows(vocab.CURATED_PROPERTY_MAP))
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = entries.select("row_id", "role", "smiles", "name", "cas_number", "pubchem_cid", "molecular_weight", "abbreviation",
                          F.explode_outer("properties").alias("property_name", "p"))
    kind = F.try_element_at(lookup, F.col("property_name"))
    return rows.select(
        F.concat_ws("/", "row_id", "property_name").alias("row_id"), "smiles", "name", "role", kind.alias("property_type"),
        F.col("p.value").alias("value"), F.coalesce("p.unit", F.lit("")).alias("unit"), F.col("p.reference").alias("reference"),
        F.lit(None).cast("string").alias("reject_reason"),
        F.when(kind.isNull(), "unknown_property").when(F.col("p.value").isNull(), "no_value").alias("value_reject"),
    )


def literature_rows(raw: DataFrame) -> DataFrame:
    """Conductivity records of electrolyte materials, converted to S/cm and range-checked."""
    spark = raw.sparkSession
    known = vocab.dimension(spark, vocab.KNOWN_MATERIALS, ["norm_name", "smiles"])
    rows = raw.where(F.col("Property") == "Conductivity").withColumn("norm_name", scalar.normalize_name(F.coalesce("Name", F.lit(""))))
    value = _num(raw, "Value")
    scaled = value * scalar.conductivity_multiplier(F.coalesce("Raw_unit", F.lit("S/cm")))
    joined = rows.join(F.broadcast(known), "norm_name", "left")
    title = F.when(F.coalesce("Title", F.lit("")) != "", F.col("Title")).otherwise(F.concat(F.lit("DOI:"), "DOI"))
    return joined.select(
        "row_id", *[c for c in ("row_no",) if c in raw.columns], "smiles", F.col("Name").alias("name"), scalar.material_role(F.col("Name")).alias("role"),
        F.coalesce(molecule_id(F.col("smiles")), F.concat(F.lit("mol-"), F.substring(F.md5("norm_name"), 1, 12))).alias("molecule_id"),
        F.lit("ionic_conductivity").alias("property_type"), scaled.alias("value"), F.lit("S/cm").alias("unit"),
        F.coalesce("DOI", F.lit("")).alias("doi"), title.alias("title"), scalar.publication_date(F.col("Date").cast("string")).alias("published_on"),
        F.when(value.isNull() | (value <= 0), "invalid")
        .when(~scalar.is_electrolyte(F.coalesce("Name", F.lit("")), F.col("Extracted_name")), "non_electrolyte").alias("reject_reason"),
        F.when(~scalar.conductivity_guard(scaled), "invalid").alias("value_reject"),
    )


def literature_sources(rows: DataFrame) -> DataFrame:
    """One source per DOI; title and date of its first kept record."""
    kept = rows.where(F.col("reject_reason").isNull() & F.col("value_reject").isNull())
    return kept.groupBy("doi").agg(F.min_by(F.struct("title", "published_on"), _place(rows)).alias("s")).select(
        F.concat(F.lit("doi:"), "doi").alias("id"), F.lit("paper").alias("source_type"), F.col("s.title").alias("name"), "doi", "s.published_on")


def genome_rows(raw: DataFrame) -> DataFrame:
    """First record per structure, its property columns as rows."""
    columns = [p for p, _ in vocab.GENOME_PROPERTIES]
    units = F.create_map(*[F.lit(x) for pair in vocab.GENOME_PROPERTIES for x in pair])
    with_structure = raw.where(F.coalesce("smiles", F.lit("")) != "")
    first = with_structure.groupBy("smiles").agg(
        F.min_by(F.struct("row_id", "task_id", "formula", "molecular_weight", *columns), _place(raw)).alias("r")
    ).select("smiles", "r.*")
    name = F.coalesce("formula", F.col("smiles"))
    long = first.select("row_id", "smiles", name.alias("name"), *columns).unpivot(
        ["row_id", "smiles", "name"], columns, "property_type", "value")
    return long.select(
        "row_id", "smiles", "name", F.lit("molecule").alias("role"), "property_type", "value",
        units[F.col("property_type")].alias("unit"), F.lit(None).cast("string").alias("reject_reason"),
        F.when(F.col("value").isNull(), "no_value").alias("value_reject"),
    )


def prediction_rows(raw: DataFrame) -> DataFrame:
    """Up to three properties per structure; values outside their open range are rejected."""
    smiles = _text(raw, "solv_comb_sm")
    made = F.array(
        F.struct(F.lit("ionic_conductivity").alias("property_type"), scalar.conductivity_from_log(_num(raw, "conductivity_log")).alias("value"), F.lit("S/cm").alias("unit")),
        F.struct(F.lit("ionization_energy").alias("property_type"), scalar.ionization_in_range(_num(raw, "IE")).alias("value"), F.lit("eV").alias("unit")),
        F.struct(F.lit("coulombic_efficiency").alias("property_type"), scalar.efficiency_from_log(_num(raw, "log_CI")).alias("value"), F.lit("dimensionless").alias("unit")),
    )
    rows = raw.select("row_id", smiles.alias("smiles"), F.inline(made))
    return rows.select(
        "row_id", "smiles", F.col("smiles").alias("name"), F.lit("solvent").alias("role"), "property_type", "value", "unit",
        F.when(F.col("smiles").isNull(), "no_structure").alias("reject_reason"), F.when(F.col("value").isNull(), "no_value").alias("value_reject"),
    )


def species_table(raw: DataFrame, zero_unknown: Column | bool = True) -> DataFrame:
    """Interphase species with alternative field names resolved.

    A zero energy, enthalpy or entropy means unknown; where ``zero_unknown`` says false of a row, it is a value.
    """
    unknown = zero_unknown if isinstance(zero_unknown, Column) else F.lit(zero_unknown)

    def pick(*names: str) -> Column:
        found = [F.col(n) for n in names if n in raw.columns]
        return F.coalesce(*found) if found else F.lit(None)

    def number(*names: str) -> Column:
        value = pick(*names).cast("string").try_cast("double")
        return F.when(~((value == 0) & F.coalesce(unknown, F.lit(False))), value)

    spin = [F.col("spin_multiplicity").cast("double")] if "spin_multiplicity" in raw.columns else []
    if "nested_spin" in raw.columns:
        spin.append(F.col("nested_spin"))
    key = F.coalesce(pick("molecule_id").cast("string"), F.concat(F.lit("libe-"), F.col("row_id").cast("string")))
    return raw.select(
        F.concat(F.lit("species-"), scalar.short_md5(16, key)).alias("id"),
        F.coalesce(pick("name").cast("string"), key).alias("name"),
        pick("smiles", "smiles_alt").cast("string").alias("smiles"), pick("inchi", "inchi_alt").cast("string").alias("inchi"),
        pick("formula_alphabetical", "formula", "molecular_formula").cast("string").alias("formula"),
        F.coalesce(pick("charge").cast("double").cast("int"), F.lit(0)).alias("charge"),
        F.coalesce(F.nullif(F.coalesce(*spin, F.lit(1.0)).cast("int"), F.lit(0)), F.lit(1)).alias("spin_multiplicity"),
        number("final_energy", "energy", "electronic_energy").alias("energy"), number("enthalpy", "H").alias("enthalpy"),
        number("entropy", "S").alias("entropy"), number("free_energy", "G").alias("free_energy"),
        F.lit("LIBE").alias("source_dataset"), F.col("row_id").cast("string").alias("source_row_id"),
    )


def _doi(source: str) -> str | None:
    return {r[0]: r[3] for r in vocab.rows(vocab.DATASETS)}[source]


def composition_tables(raw: DataFrame) -> SourceTables:
    return formulation_tables(composition_rows(raw), "composition", _doi("composition"), "ionic_conductivity", "S/cm")


def atlas_tables(raw: DataFrame, unit: str = "S/cm") -> SourceTables:
    """``unit`` states what the value column holds; values are stored as given."""
    return formulation_tables(atlas_rows(raw), "atlas", _doi("atlas"), "ionic_conductivity", unit)


def experimental_conductivity_tables(raw: DataFrame) -> SourceTables:
    return formulation_tables(
        experimental_conductivity_rows(raw), "experimental", _doi("experimental"), "ionic_conductivity", "S/cm", "structured_dataset")


def ionization_tables(raw: DataFrame) -> SourceTables:
    return molecule_tables(ionization_rows(raw), "experimental", _doi("experimental"), "dft_calculation")


def curated_tables(entries: DataFrame) -> SourceTables:
    return molecule_tables(curated_rows(entries), "curated", _doi("curated"))


def literature_tables(raw: DataFrame) -> SourceTables:
    return molecule_tables(literature_rows(raw), "literature", _doi("literature"), "nlp_chemdataextractor", 0.8, record_doi=True)


def genome_tables(raw: DataFrame) -> SourceTables:
    return molecule_tables(genome_rows(raw), "genome", _doi("genome"))


def prediction_tables(raw: DataFrame) -> SourceTables:
    return molecule_tables(prediction_rows(raw), "predictions", _doi("predictions"), "ml_prediction", 0.6)


#: What makes two rows of a table the same thing.
KEYS = {
    "molecules": ["id"], "molecule_roles": ["molecule_id", "role"], "formulations": ["id"],
    "measurements": ["id"], "provenance": ["id"], "sources": ["id"],
    "components": ["formulation_id", "molecule_id", "component_type", "position"],
    "relations": ["subject", "predicate", "object"],
}


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, by the order of the rows' values: the same whatever the partitioning."""
    if set(keys) == set(df.columns):
        return df.distinct()
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("_row")).select("_row.*")


def union_tables(parts: list[SourceTables]) -> dict[str, DataFrame]:
    """The tables of several sources together, with one row for each key.

    A molecule named twice keeps the smaller name. A formulation that several sources list has its
    components and relations once and a provenance record for each source.
    """
    def all_of(name: str) -> DataFrame | None:
        found = [getattr(p, name) for p in parts if getattr(p, name) is not None]
        return reduce(DataFrame.unionByName, found) if found else None

    out = {n: all_of(n) for n in ("formulations", "components", "measurements", "relations", "provenance", "molecule_roles")}
    out = {n: one_per_key(df, KEYS[n]) for n, df in out.items() if df is not None}
    out["molecules"] = all_of("molecules").groupBy("id").agg(F.min("name").alias("name"), F.min("smiles").alias("smiles"))
    return out
