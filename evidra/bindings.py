"""Bind the benchmark tables to the operators' input shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


LINE_PROPERTIES = ["quantity", "extendedprice", "discount", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component_type(p_type: Column) -> Column:
    return (
        F.when(p_type.isin("STANDARD", "MEDIUM"), "solvent")
        .when(p_type.isin("ECONOMY", "SMALL"), "salt")
        .otherwise("additive")
    )


def listed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the brand of their part: what components and measurements have in common."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").alias("formulation_id"),
        F.col("p_brand").alias("molecule_id"),
        *[F.col(f"l_{p}").alias(p) for p in LINE_PROPERTIES],
    )


def listed_components(listed: DataFrame) -> DataFrame:
    """(formulation_id, molecule_id) of :func:`listed_lines`, one row per line."""
    return listed.select("formulation_id", "molecule_id")


def listed_measurements(spark: SparkSession, sf_dir: str, listed: DataFrame) -> DataFrame:
    """(formulation_id, property_type, value) as in :func:`measurements`, from lines that are joined already."""
    columns = ["formulation_id", "property_type", "value"]
    long = listed.unpivot(["formulation_id"], LINE_PROPERTIES, "property_type", "value")
    return order_measurements(spark, sf_dir).select(*columns).unionByName(long.select(*columns))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the components of an order; the brand is the molecule."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").alias("formulation_id"),
        F.col("p_brand").alias("molecule_id"),
        component_type(F.col("p_type")).alias("component_type"),
        F.col("l_quantity").alias("amount"),
        F.lit("g").alias("unit"),
        F.col("l_linenumber").alias("position"),
    )


def order_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m:"), F.col("o_orderkey")).alias("id"),
        F.col("o_orderkey").alias("formulation_id"),
        F.lit("totalprice").alias("property_type"),
        F.col("o_totalprice").alias("value"),
        F.lit(None).cast("double").alias("temperature"),
        F.col("o_orderdate").cast("date").alias("measured_on"),
    )


def line_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four long rows per order line; the part size stands in for the temperature."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    wide = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.concat_ws(":", F.lit("m"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("line_id"),
        F.col("l_orderkey").alias("formulation_id"),
        F.col("p_size").cast("double").alias("temperature"),
        F.col("l_shipdate").cast("date").alias("measured_on"),
        *[F.col(f"l_{p}").alias(p) for p in LINE_PROPERTIES],
    )
    ids = ["line_id", "formulation_id", "temperature", "measured_on"]
    return wide.unpivot(ids, LINE_PROPERTIES, "property_type", "value").select(
        F.concat_ws(":", "line_id", "property_type").alias("id"),
        "formulation_id", "property_type", "value", "temperature", "measured_on",
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_measurements(spark, sf_dir).unionByName(line_measurements(spark, sf_dir))


def entity_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements of their user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("entity_id"),
        F.col("event_type").alias("property_type"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("temperature"),
        F.lit("S/cm").alias("unit"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities with a role from their segment."""
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(seg.isin("MACHINERY", "BUILDING"), "solvent").when(seg == "AUTOMOBILE", "salt").otherwise("other").alias("role"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as molecules with few distinct structure keys (their name) and many copies."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.col("p_name"), F.when(F.col("p_size") > 25, "#").otherwise(" "), F.col("p_brand")).alias("name"),
        F.concat(F.lit(" "), F.col("p_name")).alias("smiles"),
        component_type(F.col("p_type")).alias("role"),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("InChI="), F.col("p_size"))).alias("inchi"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("KEY"), F.col("p_size"))).alias("inchi_key"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_partkey")).alias("pubchem_cid"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("cas-"), F.col("p_partkey"))).alias("cas_number"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("molecular_weight"),
        F.array(F.col("p_brand")).alias("synonyms"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreign keys as a bag of edges between prefixed string ids."""
    orders = table(spark, sf_dir, "orders")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    comps = components(spark, sf_dir)
    edge = lambda s, p, o: (s.alias("subject"), p.alias("predicate"), o.alias("object"))
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    predicate = (
        F.when(F.col("component_type") == "solvent", "hasSolvent")
        .when(F.col("component_type") == "salt", "hasSalt")
        .when(F.col("component_type") == "additive", "hasAdditive")
        .otherwise("hasComponent")
    )
    return (
        comps.select(*edge(node("order:", "formulation_id"), predicate, F.col("molecule_id")))
        .unionByName(orders.select(*edge(node("order:", "o_orderkey"), F.lit("hasMeasurement"), node("m:", "o_orderkey"))))
        .unionByName(orders.select(*edge(node("customer:", "o_custkey"), F.lit("placed"), node("order:", "o_orderkey"))))
        .unionByName(supplier.select(*edge(node("supplier:", "s_suppkey"), F.lit("inNation"), node("nation:", "s_nationkey"))))
        .unionByName(nation.select(*edge(node("nation:", "n_nationkey"), F.lit("inRegion"), node("region:", "n_regionkey"))))
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence source per distinct document source."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.min("doc_id").alias("first_doc")).select(
        F.col("source").alias("id"),
        F.concat(F.lit("Source "), F.col("source")).alias("name"),
        F.when(F.col("source") != "src0", F.concat(F.lit("10.5555/"), F.col("source"))).alias("doi"),
        F.concat(F.lit("https://example.org/"), F.col("source")).alias("url"),
        F.lit("dataset").alias("source_type"),
        F.col("first_doc"),
    )


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as provenance records: of orders (en) and of their measurements (others)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    english = F.col("lang") == "en"
    method = (
        F.when(F.col("lang") == "en", "structured_dataset")
        .when(F.col("lang") == "fr", "ml_prediction")
        .when(F.col("lang") == "de", "nlp_chemdataextractor")
        .otherwise("curated")
    )
    return joined.select(
        F.concat(F.lit("prov:"), F.col("doc_id")).alias("id"),
        F.when(english, F.concat(F.lit("order:"), F.col("doc_id")))
        .otherwise(F.concat(F.lit("m:"), F.col("doc_id"))).alias("entity_id"),
        F.when(english, "ElectrolyteFormulation").otherwise("PropertyMeasurement").alias("entity_type"),
        F.when(F.col("n_chars") % 10 == 0, F.array().cast("array<string>"))
        .otherwise(F.array("source")).alias("source_ids"),
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("10.1021/acs.chemmater.4c03196."), F.col("doc_id")))
        .alias("source_doi"),
        F.concat(F.lit("row-"), F.col("doc_id")).alias("source_row_id"),
        F.lit(None).cast("string").alias("activity_id"),
        method.alias("extraction_method"),
        F.when(F.col("lang") == "fr", 0.6).when(F.col("lang") == "de", 0.8).otherwise(1.0).alias("confidence"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("validated"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("n_chars"), F.lit(1500)).cast("int")).alias("created_on"),
    )


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as hypothesis edges from their source to a length class."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    predicate = (
        F.when(F.col("lang") == "en", "increases").when(F.col("lang") == "fr", "decreases")
        .when(F.col("lang") == "de", "coOccursWith").otherwise("affects")
    )
    status = (
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "validated")
        .when(F.col("quality") == 0, "inconclusive").otherwise("proposed")
    )
    return joined.select(
        F.concat(F.lit("hyp-"), F.col("doc_id")).alias("id"),
        F.col("source").alias("subject"),
        predicate.alias("predicate"),
        F.concat(F.lit("class:"), F.col("n_chars") % 10).alias("object"),
        ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"),
        status.alias("status"),
        F.when(F.col("lang").isin("en", "es"), "rule_mining").otherwise("kg_embedding").alias("source"),
        (F.col("n_chars") % 2 == 1).alias("is_novel"),
        (F.col("n_chars") % 4 == 0).alias("passed_time_slice"),
        F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") / 100000.0).alias("model_lift"),
        F.concat(F.lit("batch-"), F.col("lang")).alias("batch_id"),
    )
