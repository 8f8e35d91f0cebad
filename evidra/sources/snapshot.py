"""Saving and loading graph tables.

The native form is one Parquet folder per table and version. The single JSON document is an
interchange format only: a document is one record, so Spark reads it as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENTITY_MAPS = ["molecules", "formulations", "measurements", "interphase_species", "sources", "methods", "provenance", "hypotheses"]


def save_tables(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Write every table below ``root/<table>/version=<version>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")


def load_table(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """One table; a version prunes to its folder, none reads all with a ``version`` column."""
    if version is None:
        return spark.read.parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}/version={version}")


def set_parent(spark: SparkSession, root: str, version: str, parent: str) -> None:
    """Record that ``version`` holds only what it adds to ``parent``; a version has one parent."""
    spark.createDataFrame([(version, parent)], "version string, parent string").write.mode("overwrite").parquet(f"{root}/_parents/of={version}")


def lineage(spark: SparkSession, root: str, version: str) -> list[str]:
    """The version and its parents, newest first; a version without a record stands alone."""
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_parents")
    if not probe.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(probe):
        return [version]
    parents = {r.version: r.parent for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/_parents").collect()}  # a row per version
    chain = [version]
    while parents.get(chain[-1]) is not None and parents[chain[-1]] not in chain:
        chain.append(parents[chain[-1]])
    return chain


def load_version(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    """A table as of a version: its change log and those of its parents, merged by key."""
    from evidra.sources import changelog

    return changelog.load(spark, root, name, version)


def append_version(spark: SparkSession, root: str, version: str, parent: str | None, counts: DataFrame, description: str = "") -> None:
    """Append a version record with its (metric, n) counts."""
    row = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "n")))).alias("counts")).select(
        F.lit(version).alias("version_name"), F.lit(parent).cast("string").alias("parent_version"), F.lit(description).alias("description"),
        "counts", F.current_timestamp().alias("created_at"))
    row.write.mode("append").parquet(f"{root}/kg_versions")


def export_json(tables: dict[str, DataFrame], root: str, compress: bool = True) -> None:
    """JSON lines per table, gzip by default."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}", compression="gzip" if compress else "none")


def export_hypotheses(hypotheses: DataFrame, summary: DataFrame, root: str) -> None:
    hypotheses.write.mode("overwrite").json(f"{root}/hypotheses")
    summary.write.mode("overwrite").json(f"{root}/summary")


def append_run(funnel: DataFrame, run_id: str, root: str) -> None:
    """Append the stages of a run, one folder per run id."""
    funnel.withColumn("recorded_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{root}/runs/run_id={run_id}")


def export_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("overwrite").json(path)


def save_embeddings(entities: DataFrame, relations: DataFrame, root: str) -> None:
    entities.write.mode("overwrite").parquet(f"{root}/entity_embeddings")
    relations.write.mode("overwrite").parquet(f"{root}/relation_embeddings")


def load_embeddings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/entity_embeddings"), spark.read.parquet(f"{root}/relation_embeddings")


def load_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a JSON or JSON.gz document: entity maps by id as (id, body), relations as edges.

    Bodies stay JSON text; pick fields with ``from_json`` or ``get_json_object``.
    """
    fields = ", ".join(f"{n} map<string,string>" for n in [*ENTITY_MAPS, "solvents", "salts"])
    doc = spark.read.schema(f"version string, {fields}, relations array<array<string>>").json(path, multiLine=True)
    out = {
        n: doc.select(F.explode(n).alias("id", "body")) for n in [*ENTITY_MAPS, "solvents", "salts"]
    }
    edge = doc.select(F.explode("relations").alias("e")).where(F.size("e") >= 3)
    out["relations"] = edge.select(F.col("e")[0].alias("subject"), F.col("e")[1].alias("predicate"), F.col("e")[2].alias("object"))
    out["version"] = doc.select("version")
    return out
