"""From mined patterns to scored, ranked and evaluated hypothesis edges.

A hypothesis row has ``subject, predicate, object, confidence`` and, for the evaluated kind,
an ``evidence`` struct whose fields are null where a strategy does not produce them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidra.functions import scalar
from evidra.operators.relational import SPO, triples
from evidra.session import cut_lineage

EFFECTS = ["increases", "decreases"]
EVIDENCE = {
    "effect_size": "double", "correlation_r": "double", "p_value": "double", "sample_size": "bigint",
    "n_with": "bigint", "n_without": "bigint", "lift": "double", "co_occurrence_count": "bigint",
}


def evidence(**fields: Column) -> Column:
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVIDENCE.items()]).alias("evidence")


def patterns_to_hypotheses(patterns: DataFrame, roles: DataFrame | None = None, min_correlation: float = 0.2) -> DataFrame:
    """Presence or amount patterns as increases/decreases edges to the property type."""
    out = patterns.where(F.abs("correlation") >= min_correlation)
    if roles is not None:
        out = out.join(roles.select(F.col("id").alias("component_id"), F.col("role").alias("subject_type")), "component_id", "left")
    else:
        out = out.withColumn("subject_type", F.lit(None).cast("string"))
    return out.select(
        F.col("component_id").cast("string").alias("subject"),
        F.coalesce("subject_type", F.lit("solvent")).alias("subject_type"),
        F.col("effect").alias("predicate"),
        scalar.property_entity_id(F.col("property_type")).alias("object"),
        F.lit("PropertyType").alias("object_type"),
        F.least(F.abs("correlation"), F.lit(1.0)).alias("confidence"),
        F.lit("rule_mining").alias("source"), F.lit("proposed").alias("status"),
    )


def rules_to_hypotheses(rules: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Rules with a consequent become coOccursWith, the others affects a property class."""
    if "consequent" not in rules.columns:
        rules = rules.withColumn("consequent", F.lit(None).cast("string"))
    target = F.col("consequent").isNotNull()
    return rules.where(F.col("confidence") >= min_confidence).select(
        F.col("antecedent").cast("string").alias("subject"), F.lit("Molecule").alias("subject_type"),
        F.when(target, "coOccursWith").otherwise("affects").alias("predicate"),
        F.coalesce(F.col("consequent").cast("string"), "head_relation").alias("object"),
        F.when(target, "Molecule").otherwise("PropertyClass").alias("object_type"),
        "confidence", F.lit("rule_mining").alias("source"), F.lit("proposed").alias("status"),
    )


def select_batch(
    candidates: Sequence[DataFrame], relations: DataFrame, max_candidates: int = 100, min_confidence: float = 0.3,
) -> DataFrame:
    """One batch: confident, new candidates; effect edges always stay, the rest fills the slots."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), candidates)
    fresh = cut_lineage(union.where(F.col("confidence") >= min_confidence).join(triples(relations), SPO, "left_anti"))
    effects = fresh.where(F.col("predicate").isin(EFFECTS))
    slots = F.greatest(F.lit(max_candidates) - effects.agg(F.count("*").alias("n")).scalar(), F.lit(0))
    order = [F.desc("confidence"), F.asc("predicate"), F.asc("subject"), F.asc("object")]
    # At most max_candidates rows reach the single-task numbering.
    best = fresh.where(~F.col("predicate").isin(EFFECTS)).orderBy(*order).limit(max_candidates)
    others = best.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).where(F.col("_rn") <= slots).drop("_rn")
    return effects.unionByName(others).withColumn("is_novel", F.lit(True))


def top_hypotheses(hypotheses: DataFrame, n: int = 10, key: str = "id", **filters) -> DataFrame:
    """Best by confidence, optionally of one status, source or predicate."""
    for column, value in filters.items():
        if value is not None:
            hypotheses = hypotheses.where(F.col(column) == value)
    return hypotheses.orderBy(F.desc("confidence"), key).limit(n)


def _proposed(df: DataFrame, strategy: int, id_parts, subject, predicate, object, names, ev) -> DataFrame:
    return df.select(
        scalar.hypothesis_id(*id_parts).alias("hypothesis_id"),
        subject.alias("subject"), predicate.alias("predicate"), object.alias("object"),
        names[0].alias("subject_name"), names[1].alias("object_name"),
        "confidence", ev, F.lit(strategy).alias("strategy"),
    )


def association_hypotheses(lifted: DataFrame) -> DataFrame:
    c1, c2, p = F.col("comp_1").cast("string"), F.col("comp_2").cast("string"), F.lit("coOccursWith")
    ev = evidence(lift=F.col("lift"), co_occurrence_count=F.col("pair_count"))
    return _proposed(lifted, 0, (c1, p, c2), c1, p, c2, (c1, c2), ev)


def correlation_hypotheses(correlated: DataFrame, min_confidence: float = 0.6, alpha: float = 0.05) -> DataFrame:
    rows = correlated.where((F.abs("r") >= min_confidence) & (F.col("p_value") < alpha)).withColumn("confidence", F.abs("r"))
    p1, p2 = F.col("property_1"), F.col("property_2")
    tag = F.lit("property:")
    direction = F.when(F.col("r") > 0, "increases").otherwise("decreases")
    ev = evidence(correlation_r=F.col("r"), p_value=F.col("p_value"), sample_size=F.col("n"))
    return _proposed(rows, 1, (p1, F.lit("correlated_with"), p2), F.concat(tag, p1), direction, F.concat(tag, p2), (p1, p2), ev)


def causal_hypotheses(contrasts: DataFrame, min_confidence: float = 0.6, alpha: float = 0.05) -> DataFrame:
    rows = contrasts.where(F.col("p_value") < alpha).withColumn(
        "confidence", F.least(F.lit(1.0), F.abs("effect_size") / 2)
    ).where(F.col("confidence") >= min_confidence)
    comp, prop = F.col("molecule_id").cast("string"), F.col("property_type")
    direction = F.when(F.col("effect_size") > 0, "increases").otherwise("decreases")
    ev = evidence(**{n: F.col(n) for n in ("effect_size", "p_value", "n_with", "n_without")})
    return _proposed(rows, 2, (comp, direction, prop), comp, direction, F.concat(F.lit("property:"), prop), (comp, prop), ev)


def with_novelty(hypotheses: DataFrame, relations: DataFrame, proposed: DataFrame) -> DataFrame:
    """0 for an existing edge, 0.2 for one already proposed, else 0.8 + 0.2 confidence."""
    known = triples(relations).withColumn("_known", F.lit(True))
    seen = triples(proposed).withColumn("_seen", F.lit(True))
    score = F.when(F.col("_known"), 0.0).when(F.col("_seen"), 0.2).otherwise(0.8 + 0.2 * F.col("confidence"))
    return hypotheses.join(known, SPO, "left").join(seen, SPO, "left").withColumn("novelty_score", score).drop("_known", "_seen")


def rank_proposals(scored: DataFrame, relations: DataFrame, top_k: int | None = None) -> DataFrame:
    """New triples only, the first strategy wins a repeated one; all of them, or the ``top_k`` by confidence x (1 + novelty)."""
    first = Window.partitionBy(*SPO).orderBy("strategy", F.desc("confidence"), "hypothesis_id")
    ranked = (
        scored.join(triples(relations), SPO, "left_anti")
        .withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")
        .withColumn("rank_score", F.col("confidence") * (1 + F.col("novelty_score")))
    )
    return ranked if top_k is None else ranked.orderBy(F.desc("rank_score"), "hypothesis_id").limit(top_k)


def plausibility(predicate: Column, ev: Column) -> tuple[Column, Column]:
    """(passed, score) of the effect-size, correlation and lift checks."""
    is_effect = predicate.isin(EFFECTS)
    size = F.abs(F.coalesce(ev["effect_size"], F.lit(0.0)))
    implausible = is_effect & (size > 5)
    by_effect = (
        F.when(~is_effect, 1.0).when(size > 5, 0.3).when(size < 0.1, 0.6)
        .otherwise(F.least(F.lit(1.0), 0.5 + 0.2 * size))
    )
    r, n = ev["correlation_r"], F.coalesce(ev["sample_size"], F.lit(10))
    correlated = is_effect & r.isNotNull()
    small = F.when(correlated & (n < 20), 0.7).otherwise(1.0)
    perfect = F.when(correlated & (F.abs(r) > 0.95) & (n > 50), 0.8).otherwise(1.0)
    lift, support = F.coalesce(ev["lift"], F.lit(1.0)), F.coalesce(ev["co_occurrence_count"], F.lit(0))
    by_lift = F.when(lift < 1.1, 0.5).when(support < 10, 0.7).otherwise(1.0)
    score = F.when(predicate == "coOccursWith", by_lift).otherwise(by_effect * small * perfect)
    return ~implausible, score


def statistical(ev: Column) -> tuple[Column, Column]:
    """(passed, score) of the p-value and sample-size checks.

    The confidence-interval check of width 2|e|/sqrt(n) > |e| cannot hold for n >= 20, so it
    adds nothing.
    """
    p = ev["p_value"]
    by_p = F.when(p > 0.05, 0.3).when(p > 0.01, 0.7).otherwise(1.0)
    pair = F.coalesce(ev["n_with"], F.lit(0)) + F.coalesce(ev["n_without"], F.lit(0))
    n = F.coalesce(ev["sample_size"], pair)
    by_n = F.when(n <= 0, 1.0).when(n < 10, 0.5).when(n < 30, 0.7).otherwise(1.0)
    return ~F.coalesce(p > 0.05, F.lit(False)), by_p * by_n


def with_consistency(hypotheses: DataFrame, molecules: DataFrame, relations: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds consistency_passed and consistency_score from the existing graph."""
    known = molecules.select(F.col("id").cast("string").alias("subject")).distinct().withColumn("_known", F.lit(True))
    opposite = F.when(F.col("predicate") == "increases", "decreases").otherwise("increases")
    against = (
        relations.where(F.col("predicate").isin(EFFECTS))
        .select("subject", opposite.alias("predicate"), "object").distinct().withColumn("_against", F.lit(True))
    )
    ranged = stats.select(F.col("property_type").alias("_prop")).withColumn("_ranged", F.lit(True))
    prop = F.regexp_replace("object_name", "^property:", "")
    joined = (
        hypotheses.join(known, "subject", "left").join(against, SPO, "left")
        .withColumn("_prop", prop).join(ranged, "_prop", "left")
    )
    named = (F.col("subject") != "") & ~F.col("subject").startswith("property:")
    unknown = F.when(named & F.col("_known").isNull(), 0.8).otherwise(1.0)
    no_range = F.when(F.col("predicate").isin(EFFECTS) & F.col("_ranged").isNull(), 0.9).otherwise(1.0)
    passed = F.col("_against").isNull()
    return joined.withColumn("consistency_passed", passed).withColumn(
        "consistency_score", F.when(passed, unknown).otherwise(0.2) * no_range
    ).drop("_prop", "_known", "_against", "_ranged")


def evaluate(
    hypotheses: DataFrame, molecules: DataFrame, relations: DataFrame, stats: DataFrame,
    run_plausibility: bool = True, run_consistency: bool = True, run_statistical: bool = True,
    validation_threshold: float = 0.7, strict_evidence: bool = False,
) -> DataFrame:
    """Verdict per hypothesis.

    The final confidence is the original one times the mean score of the passed tests (times
    0.5 if none passed). ``strict_evidence`` leaves out the effect-size check where no effect
    size was produced, instead of reading it as zero.
    """
    ev, predicate = F.col("evidence"), F.col("predicate")
    ok, score = plausibility(predicate, ev)
    if strict_evidence:
        bare = predicate.isin(EFFECTS) & ev["effect_size"].isNull()
        score = F.when(bare, score / 0.6).otherwise(score)
    out = hypotheses.withColumn("plausibility_passed", ok).withColumn("plausibility_score", score)
    ok, score = statistical(ev)
    out = out.withColumn("statistical_passed", ok).withColumn("statistical_score", score)
    out = with_consistency(out, molecules, relations, stats)
    tests = [
        name for name, on in (
            ("plausibility", run_plausibility), ("consistency", run_consistency), ("statistical", run_statistical)
        ) if on
    ]
    passed = sum((F.col(f"{t}_passed").cast("int") for t in tests), F.lit(0))
    total = sum((F.when(F.col(f"{t}_passed"), F.col(f"{t}_score")).otherwise(0.0) for t in tests), F.lit(0.0))
    mean = F.when(passed > 0, total / F.nullif(passed, F.lit(0))).otherwise(0.5)
    failed = F.lit(len(tests)) - passed
    status = (
        F.when((failed == 0) & (F.col("final_confidence") >= validation_threshold), "validated")
        .when(failed > passed, "rejected").otherwise("inconclusive")
    )
    return (
        out.withColumn("tests_passed", passed).withColumn("tests_failed", failed)
        .withColumn("final_confidence", F.col("confidence") * mean)
        .withColumn("status", status)
    )


def merge_evaluation(original: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluation results laid over the original hypotheses; the result side wins."""
    results = evaluated.select(
        "hypothesis_id", F.col("status").alias("_status"), F.col("final_confidence").alias("_confidence")
    )
    base = original if "status" in original.columns else original.withColumn("status", F.lit(None).cast("string"))
    return base.join(results, "hypothesis_id", "left").withColumns({
        "original_confidence": F.col("confidence"),
        "confidence": F.coalesce("_confidence", "confidence"),
        "status": F.coalesce("_status", "status"),
    }).drop("_status", "_confidence")


def display_table(hypotheses: DataFrame) -> DataFrame:
    """Short id and names, three-decimal confidence, default status."""
    return hypotheses.select(
        F.concat(F.substring("hypothesis_id", 1, 16), F.lit("...")).alias("id"),
        F.coalesce("predicate", F.lit("")).alias("type"),
        F.substring(F.coalesce("subject_name", F.lit("")), 1, 30).alias("subject"),
        F.substring(F.coalesce("object_name", F.lit("")), 1, 30).alias("object"),
        F.format_number(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"),
        F.coalesce("status", F.lit("validated")).alias("status"),
    )
