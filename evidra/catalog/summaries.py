"""Counting and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra import bindings as B, vocab
from evidra.catalog import query
from evidra.catalog.common import rounded
from evidra.catalog.sqlparts import with_
from evidra.operators import summaries as SU


@query("graph_stats", "W-53", with_("components relations line_measurements hypotheses sources provenance", """
    SELECT 'num_molecules' AS metric, count(DISTINCT p_brand) AS n FROM part
    UNION ALL SELECT 'num_formulations', count(*) FROM orders UNION ALL SELECT 'num_measurements', count(*) FROM line_measurements
    UNION ALL SELECT 'num_sources', count(*) FROM sources UNION ALL SELECT 'num_relations', count(*) FROM relations
    UNION ALL SELECT 'num_provenance', count(*) FROM provenance UNION ALL SELECT 'num_hypotheses', count(*) FROM hypotheses
    UNION ALL SELECT 'num_' || component_type || 's', count(DISTINCT molecule_id) FROM components GROUP BY component_type
    UNION ALL SELECT 'num_hypotheses_validated', count(*) FROM hypotheses WHERE status = 'validated'"""))
def graph_stats(spark, sf):
    roles = B.components(spark, sf).select("molecule_id", F.col("component_type").alias("role"))
    return SU.graph_stats({
        "molecules": B.table(spark, sf, "part").select("p_brand").distinct(), "formulations": B.table(spark, sf, "orders"),
        "measurements": B.line_measurements(spark, sf), "sources": B.sources(spark, sf), "relations": B.relations(spark, sf),
        "provenance": B.provenance(spark, sf), "hypotheses": B.hypotheses(spark, sf),
    }, roles, B.hypotheses(spark, sf))


@query("role_counts", "W-60", with_("customers", """
    SELECT role, count(*) AS n FROM customers WHERE role <> 'other' GROUP BY 1
    UNION ALL SELECT 'other', (SELECT count(*) FROM customers) - (SELECT count(*) FROM customers WHERE role <> 'other')"""))
def role_counts(spark, sf):
    c = B.customers(spark, sf)
    return SU.role_counts(c, c.select(F.col("id").alias("molecule_id"), "role"))


@query("measurements_by_property", "W-57", with_("measurements", """
    SELECT property_type, count(*) AS n FROM measurements GROUP BY 1 ORDER BY n DESC, property_type LIMIT 8"""))
def measurements_by_property(spark, sf):
    return SU.top_counts(B.measurements(spark, sf), "property_type", 8)


@query("relations_by_predicate", "W-59", with_("relations", """
    SELECT predicate, count(*) AS n FROM relations GROUP BY 1 ORDER BY n DESC, predicate LIMIT 10"""))
def relations_by_predicate(spark, sf):
    return SU.top_counts(B.relations(spark, sf), "predicate", 10)


@query("prediction_split", "W-58", with_("provenance", """
    SELECT count(*) FILTER (extraction_method <> 'ml_prediction') AS experimental, count(*) FILTER (extraction_method = 'ml_prediction') AS predicted FROM provenance"""))
def prediction_split(spark, sf):
    return SU.prediction_split(B.provenance(spark, sf))


@query("records_per_category", "W-56", with_("provenance", """
    SELECT CASE WHEN extraction_method = 'ml_prediction' THEN 'ML Predictions (Electrolytomics)'
                WHEN contains(coalesce(source_doi, ''), '10.1021/acs.chemmater.4c03196') THEN 'Electrolytomics (Experimental)'
                WHEN contains(extraction_method, 'chemdataextractor') THEN 'ChemDataExtractor'
                WHEN contains(extraction_method, 'curated') THEN 'Curated Properties' ELSE 'Other' END AS category, count(*) AS n FROM provenance GROUP BY 1"""))
def records_per_category(spark, sf):
    return SU.records_per_category(B.provenance(spark, sf))


def _zero_filled():
    pairs = [("status", s) for s in vocab.HYPOTHESIS_STATUSES] + [("source", s) for s in vocab.HYPOTHESIS_SOURCES]
    return ", ".join(f"('{d}', '{v}')" for d, v in pairs)


@query("hypothesis_summary", "W-64", with_("hypotheses", f"""
    SELECT dimension, value, count(h.id) AS n FROM (VALUES {_zero_filled()}) v(dimension, value)
    LEFT JOIN hypotheses h ON (dimension = 'status' AND h.status = value) OR (dimension = 'source' AND h.source = value) GROUP BY ALL"""))
def hypothesis_summary(spark, sf):
    return SU.hypothesis_summary(B.hypotheses(spark, sf))


@query("hypothesis_totals", "W-64", with_("hypotheses", """
    SELECT count(*) AS total_hypotheses, count(*) FILTER (is_novel) AS num_novel, count(DISTINCT batch_id) AS num_batches,
           round(avg(confidence), 6) AS avg_confidence FROM hypotheses"""))
def hypothesis_totals(spark, sf):
    return rounded(SU.hypothesis_totals(B.hypotheses(spark, sf)), 6, "avg_confidence")


@query("batch_counters", "W-65", with_("hypotheses", """
    SELECT batch_id, count(*) AS num_proposed, count(*) FILTER (is_novel) AS num_novel, count(*) FILTER (status = 'validated') AS num_validated,
           count(*) FILTER (status = 'rejected') AS num_rejected FROM hypotheses GROUP BY 1"""))
def batch_counters(spark, sf):
    return SU.batch_counters(B.hypotheses(spark, sf))


@query("discovery_metrics", "W-66", with_("hypotheses", """
    SELECT count(*) AS num_proposed, count(*) FILTER (is_novel) AS num_novel, count(*) FILTER (passed_time_slice) AS num_passed_time_slice,
           count(*) FILTER (status = 'validated') AS num_validated, count(*) FILTER (status = 'rejected') AS num_rejected,
           round(avg(confidence), 6) AS avg_confidence, round(avg(model_lift) FILTER (status = 'validated'), 6) AS avg_model_lift,
           round(sum(model_lift) FILTER (status = 'validated'), 4) AS total_model_lift,
           round(count(*) FILTER (status = 'validated') * 1.0 / count(*) FILTER (status IN ('validated', 'rejected')), 6) AS validation_rate,
           round(count(*) FILTER (is_novel) * 1.0 / count(*), 6) AS novelty_rate FROM hypotheses"""))
def discovery_metrics(spark, sf):
    out = SU.discovery_metrics(B.hypotheses(spark, sf))
    return rounded(rounded(out, 6, "avg_confidence", "avg_model_lift", "validation_rate", "novelty_rate"), 4, "total_model_lift")


@query("grouped_values", "W-70", with_("entity_measurements", """
    SELECT entity_id, property_type, string_agg(value || ' ' || unit, ', ' ORDER BY rn) FILTER (rn <= 5) AS shown, greatest(count(*) - 5, 0) AS more
    FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, property_type ORDER BY id) AS rn FROM entity_measurements) GROUP BY ALL"""))
def grouped_values(spark, sf):
    return SU.grouped_values(B.entity_measurements(spark, sf), 5)


@query("ingestion_stats", "W-72", """
    WITH t AS (SELECT source, CASE WHEN n_chars % 10 = 0 THEN 'invalid' WHEN lang = 'es' THEN 'non_electrolyte' END AS r FROM documents)
    SELECT coalesce(r, 'processed') AS outcome, count(*) AS n FROM t GROUP BY 1
    UNION ALL SELECT 'unique_dois', count(DISTINCT source) FROM t WHERE r IS NULL""")
def ingestion_stats(spark, sf):
    reason = F.when(F.col("n_chars") % 10 == 0, "invalid").when(F.col("lang") == "es", "non_electrolyte")
    return SU.ingestion_stats(B.table(spark, sf, "documents").withColumn("reject_reason", reason), "source")


@query("stats_delta", "W-73 W-129", with_("relations", """
    SELECT predicate AS metric, count(*) FILTER (predicate <> 'inRegion' AND object <> 'Brand#1') AS before, count(*) AS after,
           count(*) - count(*) FILTER (predicate <> 'inRegion' AND object <> 'Brand#1') AS delta FROM relations GROUP BY 1"""))
def stats_delta(spark, sf):
    by = lambda df: df.groupBy(F.col("predicate").alias("metric")).agg(F.count("*").alias("n"))
    edges = B.relations(spark, sf)
    return SU.stats_delta(by(edges.where("predicate <> 'inRegion' AND object <> 'Brand#1'")), by(edges))


@query("status_funnel", "W-67", with_("hypotheses", """
    SELECT 'proposed' AS stage, count(*) AS n FROM hypotheses UNION ALL SELECT 'novel', count(*) FROM hypotheses WHERE is_novel
    UNION ALL SELECT 'validated', count(*) FROM hypotheses WHERE is_novel AND status = 'validated'"""))
def status_funnel(spark, sf):
    h = B.hypotheses(spark, sf)
    novel = h.where("is_novel")
    return SU.funnel(proposed=h, novel=novel, validated=novel.where("status = 'validated'"))
