"""Raw scans. Columns stay as written; parsing and rejection happen in ``normalize``.

Every reader adds ``row_id``: the hash of the row's values and, for the second and later of equal
rows, which one it is. The ids of a file do not depend on how it is split or laid out, and rows of
different files share an id only if they are equal. ``row_no`` is the place in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

CURATED_SCHEMA = """
    solvents array<struct<name:string, abbreviation:string, smiles:string, cas_number:string, pubchem_cid:bigint,
        molecular_weight:double, cation:string, anion:string,
        properties:map<string, struct<value:double, unit:string, method:string, reference:string>>>>,
    salts array<struct<name:string, abbreviation:string, smiles:string, cas_number:string, pubchem_cid:bigint,
        molecular_weight:double, cation:string, anion:string,
        properties:map<string, struct<value:double, unit:string, method:string, reference:string>>>>
"""
GENOME_SCHEMA = """
    task_id string, smiles string, formula string, charge bigint, molecular_weight double, point_group string,
    ionization_energy double, electron_affinity double, oxidation_potential_li double, reduction_potential_li double,
    oxidation_potential_mg double, reduction_potential_mg double, oxidation_potential_h double, reduction_potential_h double,
    functional_groups array<string>, base_molecule string
"""
# Species fields by the names they may carry; names differing only in case are distinct.
SPECIES_FIELDS = {
    "molecule_id": "string", "name": "string", "smiles": "string", "SMILES": "string", "inchi": "string", "InChI": "string",
    "formula_alphabetical": "string", "formula": "string", "molecular_formula": "string", "charge": "double",
    "spin_multiplicity": "double", "molecule.spin_multiplicity": "double", "final_energy": "double", "energy": "double",
    "electronic_energy": "double", "enthalpy": "double", "H": "double", "entropy": "double", "S": "double",
    "free_energy": "double", "G": "double", "chemical_system": "string",
}
SPECIES_RENAMED = {"SMILES": "smiles_alt", "InChI": "inchi_alt", "molecule.spin_multiplicity": "nested_spin"}


#: Equal rows of a file beyond so many are spread over tasks.
COPIES = 4_096


def content_id(*columns: Column) -> Column:
    """A hash of values; nulls and empty strings differ."""
    return F.substring(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 1, 20)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``row_id`` and its place ``row_no``, which only says what comes first.

    Equal rows are counted map-side. They are spread out again where their count is, up to ``COPIES`` of them; a row
    with more travels as blocks of that many, so one that makes up a third of a file is no task of that size.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    maps = [f.name for f in df.schema if isinstance(f.dataType, MapType)]  # cannot be grouped by; equal where the hash is
    placed = df.withColumns({"_id": content_id(*columns), "row_no": F.monotonically_increasing_id()})
    counted = placed.groupBy("_id", *[F.col(f"`{c}`") for c in df.columns if c not in maps]).agg(
        F.count("*").alias("_n"), F.min("row_no").alias("row_no"), *[F.any_value(c).alias(c) for c in maps])
    few = counted.where(F.col("_n") <= COPIES).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    blocks = counted.where(F.col("_n") > COPIES).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as blocks have few bytes and many rows
    inside = F.sequence(F.col("_b") * COPIES + 1, F.least((F.col("_b") + 1) * COPIES, F.col("_n")))
    many = blocks.repartition(tasks, "_id", "_b").withColumn("_k", F.explode(inside)).drop("_b")
    which = few.unionByName(many)
    return which.select(*columns, "row_no", F.when(F.col("_k") == 1, F.col("_id")).otherwise(F.concat_ws("-", "_id", "_k")).alias("row_id"))


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return numbered(spark.read.csv(path, sep=sep, header=True))


def composition_csv(spark: SparkSession, path: str) -> DataFrame:
    """``;`` or ``,`` separated masses, temperature and conductivity; the header line decides."""
    header = spark.read.text(path).limit(1).first()
    return _csv(spark, path, ";" if header and ";" in header[0] else ",")


def atlas_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path)


def experimental_csv(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The conductivity, ionization-energy and efficiency files below ``folder``."""
    files = {
        "conductivity": "datasets/raw/conductivity/EDB-1_conductivity.csv",
        "ionization": "datasets/raw/oxstab/MP_oxstab.csv",
        "efficiency": "datasets/raw/CE/EDB-2_ce.csv",
    }
    return {k: _csv(spark, f"{folder}/{v}") for k, v in files.items()}


def predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path)


def literature_csv(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'))


def curated_json(spark: SparkSession, path: str) -> DataFrame:
    """(kind, entry): the solvents and salts of a curated document."""
    doc = spark.read.schema(CURATED_SCHEMA).json(path, multiLine=True)
    kinds = [doc.select(F.lit(kind).alias("role"), F.explode(column).alias("m")) for kind, column in (("solvent", "solvents"), ("salt", "salts"))]
    rows = kinds[0].unionByName(kinds[1])
    return numbered(rows.select("role", "m.*"))


def genome_json(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.schema(GENOME_SCHEMA).json(path, multiLine=True))


def _species_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of species, or a document with a ``molecules`` or ``species`` list.

    Map keys keep their case, so ``smiles`` and ``SMILES`` stay apart.
    """
    text = spark.read.text(path, wholetext=True)
    entry = "array<map<string,string>>"
    nested = F.from_json("value", f"molecules {entry}, species {entry}")
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", entry)).otherwise(
        F.coalesce(nested["molecules"], nested["species"])
    )
    maps = text.select(F.explode(listed).alias("m"))

    def field(name: str):
        if "." in name:
            outer, inner = name.split(".")
            return F.get_json_object(F.try_element_at("m", F.lit(outer)), f"$.{inner}")
        return F.try_element_at("m", F.lit(name))

    return maps.select(*[field(k).try_cast(t).alias(SPECIES_RENAMED.get(k, k)) for k, t in SPECIES_FIELDS.items()])


def species(spark: SparkSession, path: str, max_species: int | None = None) -> DataFrame:
    """Species from JSON (a list) or CSV, optionally the first ``max_species`` rows."""
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True)
    else:
        raw = _species_json(spark, path)
    if max_species is not None:
        raw = raw.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(max_species).drop("_at")
    return numbered(raw)


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(abbreviation, name, smiles) of a ``;`` table without header; BOM and blanks removed."""
    raw = spark.read.csv(path, sep=";", schema="abbreviation string, name string, smiles string")
    clean = lambda c: F.trim(F.replace(F.col(c), F.lit("﻿"), F.lit("")))
    return raw.select(*[clean(c).alias(c) for c in raw.columns]).where(F.col("abbreviation") != "")


def latest_run(spark: SparkSession, pattern: str) -> DataFrame:
    """The JSON run record with the newest modification time among the matching files."""
    runs = spark.read.json(pattern, multiLine=True).select("*", F.col("_metadata.file_modification_time").alias("modified_at"),
                                                         F.col("_metadata.file_path").alias("file"))
    newest = runs.agg(F.max(F.struct("modified_at", "file")).alias("m")).scalar()
    return runs.where(F.struct("modified_at", "file") == newest)
