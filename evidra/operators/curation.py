"""Curation: queue, decisions, merging into the graph, negative evidence.

``decisions(hypothesis_id, decision, curator, rationale, decided_at, modifications)`` is an
append-only table; ``modifications`` maps hypothesis columns to new values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidra import vocab
from evidra.functions import scalar
from evidra.operators.relational import SPO, triples


def curation_queue(evaluated: DataFrame, confidence: str = "final_confidence", review_from: float = 0.5) -> DataFrame:
    """Validated edges are ready to merge; inconclusive ones from ``review_from`` need review."""
    action = F.when(F.col("status") == "validated", "ready_to_merge").when(
        (F.col("status") == "inconclusive") & (F.col(confidence) >= review_from), "needs_review"
    )
    return evaluated.withColumn("action", action).where(F.col("action").isNotNull())


def decision_rows(
    hypotheses: DataFrame, decision: str, rationale: Column, curator: str = "human",
    decided_at: Column | None = None, modifications: Column | None = None,
) -> DataFrame:
    """Rows to append to the decision log."""
    if decision not in vocab.CURATION_OUTCOMES:
        raise ValueError(f"unknown decision {decision!r}")
    return hypotheses.select(
        "hypothesis_id", F.lit(decision).alias("decision"), F.lit(curator).alias("curator"),
        rationale.alias("rationale"),
        (F.current_timestamp() if decided_at is None else decided_at).alias("decided_at"),
        (F.lit(None).cast("map<string,string>") if modifications is None else modifications).alias("modifications"),
    )


def auto_approve(hypotheses: DataFrame, threshold: float, decided_at: Column | None = None) -> DataFrame:
    rationale = F.concat(
        F.lit("Auto-approved: confidence "), F.format_number("confidence", 3), F.lit(f" >= threshold {threshold}")
    )
    return decision_rows(
        hypotheses.where(F.col("confidence") >= threshold), "approved", rationale, "auto", decided_at
    )


def pending(hypotheses: DataFrame, decisions: DataFrame) -> DataFrame:
    return hypotheses.join(decisions.select("hypothesis_id"), "hypothesis_id", "left_anti")


def _modified(column: str, key: str) -> Column:
    return F.coalesce(F.try_element_at("modifications", F.lit(key)), F.col(column).cast("string"))


def merge_approved(decisions: DataFrame, hypotheses: DataFrame, relations: DataFrame) -> DataFrame:
    """New edges of approved decisions: modified, complete, not yet in the graph, once each."""
    approved = decisions.where(F.col("decision") == "approved").join(hypotheses, "hypothesis_id")
    edited = approved.withColumns({
        "subject": _modified("subject", "subject_id"),
        "predicate": _modified("predicate", "hypothesis_type"),
        "object": _modified("object", "object_id"),
        "confidence": F.coalesce(F.try_element_at("modifications", F.lit("confidence")).try_cast("double"), F.col("confidence")),
    })
    complete = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in SPO])
    once = Window.partitionBy(*SPO).orderBy("decided_at", "hypothesis_id")
    return (
        edited.where(complete).join(triples(relations), SPO, "left_anti")
        .withColumn("_rn", F.row_number().over(once)).where(F.col("_rn") == 1)
        .select(
            scalar.edge_id(F.col("subject"), F.col("predicate"), F.col("object")).alias("edge_id"),
            *SPO, "hypothesis_id", "confidence", "curator", "rationale", "decided_at",
        )
    )


def merge_provenance(merged: DataFrame, original: DataFrame) -> DataFrame:
    """Provenance rows of merged edges, with the confidence before evaluation."""
    before = F.coalesce("original_confidence", "confidence") if "original_confidence" in original.columns else F.col("confidence")
    first = original.select("hypothesis_id", before.alias("original_confidence"))
    return merged.join(first, "hypothesis_id", "left").select(
        F.concat(F.lit("prov-"), F.substring(F.md5("edge_id"), 1, 12)).alias("id"),
        F.col("edge_id").alias("entity_id"), F.lit("merged_hypothesis").alias("entity_type"),
        F.lit("discovery_pipeline").alias("extraction_method"),
        "hypothesis_id", "original_confidence", F.col("confidence").alias("validated_confidence"),
        "curator", "rationale",
    )


def mark_merged(hypotheses: DataFrame, merged: DataFrame) -> DataFrame:
    """Hypotheses with the status and edge id their merge gave them."""
    m = merged.select("hypothesis_id", F.col("edge_id"))
    out = hypotheses.join(m, "hypothesis_id", "left")
    return out.withColumn("merged", F.col("edge_id").isNotNull()).withColumn(
        "status", F.when(F.col("merged"), "validated").otherwise(F.col("status"))
    )


def negative_evidence(decisions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Rejected decisions with their hypotheses; the last rejection of an id counts."""
    last = Window.partitionBy("hypothesis_id").orderBy(F.desc("decided_at"), "curator")
    rejected = (
        decisions.where(F.col("decision") == "rejected")
        .withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") == 1)
        .select("hypothesis_id", F.col("curator").alias("rejected_by"), F.col("rationale").alias("rejection_rationale"),
                F.col("decided_at").alias("rejected_at"))
    )
    return hypotheses.drop("status").join(rejected, "hypothesis_id").withColumn("status", F.lit("rejected"))


def apply_validations(hypotheses: DataFrame, validations: DataFrame) -> DataFrame:
    """Status, method and lift of the latest ``validations(id, status, method, model_lift, at)``."""
    latest = validations.groupBy("id").agg(
        F.max_by(F.struct("status", "method", "model_lift"), F.struct("at", "method")).alias("_v"),
        F.count("*").alias("n_validations"),
    )
    return hypotheses.join(latest, "id", "left").withColumns({
        "status": F.coalesce("_v.status", "status"),
        "validated_by": F.col("_v.method"),
        "model_lift": F.when(F.col("_v").isNotNull(), F.col("_v.model_lift")).otherwise(F.col("model_lift")),
        "n_validations": F.coalesce("n_validations", F.lit(0)).cast("bigint"),
    }).drop("_v")


def evidence_rows(validations: DataFrame) -> DataFrame:
    """(id, side, evidence): evidence of validations supports, that of rejections contradicts."""
    side = F.when(F.col("status") == "validated", "supporting").when(F.col("status") == "rejected", "contradicting")
    return validations.where(side.isNotNull()).select("id", side.alias("side"), F.explode("evidence").alias("evidence"))


def merge_validated(hypotheses: DataFrame) -> DataFrame:
    """Graph edges and provenance columns of validated hypotheses."""
    return hypotheses.where(F.col("status") == "validated").select(
        *SPO, F.col("id").alias("entity_id"), F.lit("merged_hypothesis").alias("entity_type"),
        F.concat(F.lit("hypothesis_validation:"), "source").alias("extraction_method"),
        "confidence", F.lit(True).alias("validated"), F.col("validated_by").alias("validation_method"),
    )


def curation_summary(decisions: DataFrame, merged: DataFrame, waiting: DataFrame) -> DataFrame:
    """Counts by decision (zero-filled), merged edges and pending reviews as (metric, n)."""
    spark = decisions.sparkSession
    names = spark.createDataFrame([(d,) for d in vocab.CURATION_OUTCOMES], "metric string")
    by = decisions.groupBy(F.col("decision").alias("metric")).agg(F.count("*").alias("n"))
    filled = names.join(by, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    return (
        filled.unionByName(count(decisions, "total_decisions")).unionByName(count(merged, "merged_edges"))
        .unionByName(count(waiting, "pending_review"))
    )
