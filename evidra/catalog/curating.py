"""Hypothesis generation, evaluation, curation and the discovery loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra import bindings as B
from evidra.catalog import mining as MQ, query
from evidra.catalog.common import rounded
from evidra.catalog.graph import GAP_CTES
from evidra.catalog.sqlparts import with_
from evidra.operators import curation as C, hypotheses as H, mining as M, stats as ST, summaries as SU
from evidra.plans import discovery as D
from evidra.session import cut_lineage

PATTERN_CTES = dict(
    mult=MQ.MULT,
    f="SELECT formulation_id, count(*) AS fn, sum(value) AS fs FROM measurements WHERE property_type = 'extendedprice' GROUP BY 1",
    tot0="SELECT count(*) AS n, sum(value) AS s, stddev_pop(value) AS sd FROM measurements WHERE property_type = 'extendedprice'",
    pe="""SELECT molecule_id, (sum(m * fs) / sum(m * fn) - (any_value(s) - sum(fs)) / (any_value(n) - sum(fn))) / (any_value(sd) + 1e-8) AS effect
          FROM mult JOIN f USING (formulation_id), tot0 GROUP BY 1 HAVING sum(m * fn) >= 5 AND any_value(n) - sum(fn) >= 5""",
    pattern_h="""SELECT molecule_id AS subject, CASE WHEN effect > 0 THEN 'increases' ELSE 'decreases' END AS predicate, 'property_type:extendedprice' AS object,
                 'PropertyType' AS object_type, least(abs(effect), 1.0) AS confidence FROM pe WHERE abs(effect) >= 0.01""",
    **MQ.RULES_CTES,
    rule_h="""SELECT a AS subject, 'coOccursWith' AS predicate, b AS object, 'Molecule' AS object_type, n * 1.0 / ca.c AS confidence
              FROM (SELECT a, b, n FROM pairs UNION ALL SELECT b, a, n FROM pairs) p JOIN cnt ca ON ca.molecule_id = a WHERE n >= 3 AND n * 1.0 / ca.c >= 0.05""")


def _patterns(spark, sf):
    return M.presence_effects(B.components(spark, sf), B.line_measurements(spark, sf), "extendedprice", min_correlation=0.01)


@query("pattern_hypotheses", "W-85", with_("components measurements", """
    SELECT subject, predicate, object, object_type, round(confidence, 6) AS confidence FROM pattern_h""", **PATTERN_CTES))
def pattern_hypotheses(spark, sf):
    out = H.patterns_to_hypotheses(_patterns(spark, sf), min_correlation=0.01)
    return rounded(out.select("subject", "predicate", "object", "object_type", "confidence"), 6, "confidence")


@query("rule_hypotheses", "W-86", with_("components measurements", """
    SELECT subject, predicate, object, object_type, round(confidence, 6) AS confidence FROM rule_h
    UNION ALL SELECT molecule_id, 'affects', class || '_extendedprice', 'PropertyClass', round(k / n, 6) FROM long WHERE k >= 3 AND k / n >= 0.2""",
    **MQ.RULES_CTES, rule_h=PATTERN_CTES["rule_h"], **MQ.THRESHOLD_CTES))
def rule_hypotheses(spark, sf):
    comps = B.components(spark, sf)
    co = H.rules_to_hypotheses(M.co_occurrence_rules(comps, min_confidence=0.05), 0.05)
    th = H.rules_to_hypotheses(M.threshold_rules(comps, B.line_measurements(spark, sf), "extendedprice", min_confidence=0.2), 0.2)
    return rounded(co.unionByName(th).select("subject", "predicate", "object", "object_type", "confidence"), 6, "confidence")


@query("hypothesis_batch", "W-105", with_("components measurements", """
    WITH known AS (SELECT p_brand AS subject, 'coOccursWith' AS predicate, 'Brand#9' AS object FROM part GROUP BY 1 HAVING 2 * sum(p_size) >= 51 * count(*)),
    u AS (SELECT * FROM pattern_h UNION ALL SELECT * FROM rule_h),
    fresh AS (SELECT * FROM u WHERE confidence >= 0.01 AND (subject, predicate, object) NOT IN (SELECT (subject, predicate, object) FROM known)),
    eff AS (SELECT * FROM fresh WHERE predicate IN ('increases', 'decreases')),
    oth AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, predicate, subject, object) AS rn FROM fresh WHERE predicate NOT IN ('increases', 'decreases'))
    SELECT subject, predicate, object, round(confidence, 6) AS confidence FROM eff
    UNION ALL SELECT subject, predicate, object, round(confidence, 6) FROM oth WHERE rn <= greatest(0, 60 - (SELECT count(*) FROM eff))""", **PATTERN_CTES).replace(
        "\nWITH known AS", ",\nknown AS"))
def hypothesis_batch(spark, sf):
    large = B.table(spark, sf, "part").groupBy(F.col("p_brand").alias("subject")).agg(F.expr(LARGE).alias("large")).where("large")
    known = large.select("subject", F.lit("coOccursWith").alias("predicate"), F.lit("Brand#9").alias("object"))
    rules = H.rules_to_hypotheses(M.co_occurrence_rules(B.components(spark, sf), min_confidence=0.05), 0.05)
    patterns = H.patterns_to_hypotheses(_patterns(spark, sf), min_correlation=0.01)
    batch = H.select_batch([patterns, rules], known, max_candidates=60, min_confidence=0.01)
    return rounded(batch.select("subject", "predicate", "object", "confidence"), 6, "confidence")


@query("top_hypotheses", "W-106", with_("hypotheses", """
    SELECT id, confidence FROM hypotheses WHERE status = 'validated' AND source = 'rule_mining' ORDER BY confidence DESC, id LIMIT 10"""))
def top_hypotheses(spark, sf):
    return H.top_hypotheses(B.hypotheses(spark, sf), 10, status="validated", source="rule_mining").select("id", "confidence")


# --- the loop: propose, score, evaluate ---

MIN_CONF, ALPHA = 0.01, 0.5
#: What the loop finds in the graph, from all parts: brands of large parts and of small ones.
LARGE = "2 * sum(p_size) >= 51 * count(*)"
LOOP_CTES = {
    **MQ.LIFT_CTES, **MQ.CORR_CTES, **MQ.CAUSAL_CTES,
    "brands": f"SELECT p_brand AS subject, {LARGE} AS large FROM part GROUP BY 1",
    "mols": "SELECT subject AS id FROM brands WHERE large",
    "known": """SELECT subject, CASE WHEN large THEN 'increases' ELSE 'decreases' END AS predicate, 'property:quantity' AS object FROM brands
                UNION ALL SELECT subject, 'coOccursWith', 'Brand#9' FROM brands WHERE large""",
    "earlier": "SELECT subject, 'coOccursWith' AS predicate, 'Brand#8' AS object FROM brands",
    "props": f"""
        SELECT 'hyp-' || substr(md5(comp_1 || ':coOccursWith:' || comp_2), 1, 12) AS hypothesis_id, comp_1 AS subject, 'coOccursWith' AS predicate, comp_2 AS object,
               comp_2 AS object_name, least(1.0, lift / 2) AS confidence, NULL::DOUBLE AS effect, NULL::DOUBLE AS r, NULL::DOUBLE AS p, NULL::BIGINT AS ss,
               NULL::BIGINT AS nw, NULL::BIGINT AS nwo, lift, pair_count AS cnt, 0 AS strategy FROM lifted WHERE least(1.0, lift / 2) >= {MIN_CONF}
        UNION ALL SELECT 'hyp-' || substr(md5(property_1 || ':correlated_with:' || property_2), 1, 12), 'property:' || property_1, CASE WHEN r > 0 THEN 'increases' ELSE 'decreases' END,
               'property:' || property_2, property_2, abs(r), NULL, r, p, n, NULL, NULL, NULL, NULL, 1 FROM correlated WHERE abs(r) >= {MIN_CONF} AND p < {ALPHA}
        UNION ALL SELECT 'hyp-' || substr(md5(molecule_id || ':' || CASE WHEN effect > 0 THEN 'increases' ELSE 'decreases' END || ':' || property_type), 1, 12), molecule_id,
               CASE WHEN effect > 0 THEN 'increases' ELSE 'decreases' END, 'property:' || property_type, property_type, least(1.0, abs(effect) / 2), effect, NULL, p, NULL, n1, n2, NULL, NULL, 2
        FROM contrast WHERE p < {ALPHA} AND least(1.0, abs(effect) / 2) >= {MIN_CONF}""",
    "novel": """SELECT *, CASE WHEN (subject, predicate, object) IN (SELECT (subject, predicate, object) FROM known) THEN 0
                               WHEN (subject, predicate, object) IN (SELECT (subject, predicate, object) FROM earlier) THEN 0.2 ELSE 0.8 + 0.2 * confidence END AS novelty FROM props""",
    "ranked": """SELECT * FROM (SELECT *, confidence * (1 + novelty) AS rank_score FROM novel WHERE novelty > 0
                  QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY strategy, confidence DESC, hypothesis_id) = 1)""",
    "tested": """SELECT *, NOT (predicate <> 'coOccursWith' AND abs(coalesce(effect, 0)) > 5) AS pp,
        CASE WHEN predicate = 'coOccursWith' THEN CASE WHEN lift < 1.1 THEN 0.5 WHEN cnt < 10 THEN 0.7 ELSE 1 END
             ELSE (CASE WHEN abs(coalesce(effect, 0)) > 5 THEN 0.3 WHEN abs(coalesce(effect, 0)) < 0.1 THEN 0.6 ELSE least(1, 0.5 + 0.2 * abs(effect)) END)
                  * CASE WHEN r IS NOT NULL AND ss < 20 THEN 0.7 ELSE 1 END * CASE WHEN abs(coalesce(r, 0)) > 0.95 AND ss > 50 THEN 0.8 ELSE 1 END END AS ps,
        NOT coalesce(p > 0.05, false) AS sp,
        CASE WHEN p > 0.05 THEN 0.3 WHEN p > 0.01 THEN 0.7 ELSE 1 END * CASE WHEN coalesce(ss, coalesce(nw, 0) + coalesce(nwo, 0)) <= 0 THEN 1
             WHEN coalesce(ss, nw + nwo) < 10 THEN 0.5 WHEN coalesce(ss, nw + nwo) < 30 THEN 0.7 ELSE 1 END AS sc,
        NOT EXISTS (SELECT 1 FROM known k WHERE k.subject = ranked.subject AND k.object = ranked.object AND ranked.predicate <> 'coOccursWith'
                    AND k.predicate = CASE ranked.predicate WHEN 'increases' THEN 'decreases' ELSE 'increases' END) AS cp,
        CASE WHEN NOT starts_with(subject, 'property:') AND subject NOT IN (SELECT id FROM mols) THEN 0.8 ELSE 1 END
          * CASE WHEN predicate <> 'coOccursWith' AND object_name NOT IN (SELECT DISTINCT property_type FROM measurements) THEN 0.9 ELSE 1 END AS cs FROM ranked""",
    "verdicts": """SELECT *, CASE WHEN failed = 0 AND final_confidence >= 0.2 THEN 'validated' WHEN failed > passed THEN 'rejected' ELSE 'inconclusive' END AS status FROM (
        SELECT *, 3 - passed AS failed, confidence * CASE WHEN passed > 0 THEN (CASE WHEN pp THEN ps ELSE 0 END + CASE WHEN cp THEN cs ELSE 0 END + CASE WHEN sp THEN sc ELSE 0 END) / passed ELSE 0.5 END AS final_confidence
        FROM (SELECT *, CAST(pp AS INT) + CAST(cp AS INT) + CAST(sp AS INT) AS passed FROM tested))""",
}


def loop_inputs(spark, sf):
    brands = B.table(spark, sf, "part").groupBy(F.col("p_brand").alias("subject")).agg(F.expr(LARGE).alias("large"))
    edge = lambda rows, predicate, object: rows.select("subject", predicate.alias("predicate"), F.lit(object).alias("object"))
    direction = F.when(F.col("large"), "increases").otherwise("decreases")
    together = F.lit("coOccursWith")
    known = edge(brands, direction, "property:quantity").unionByName(edge(brands.where("large"), together, "Brand#9"))
    earlier = edge(brands, together, "Brand#8")
    mols = brands.where("large").select(F.col("subject").alias("id"), F.lit("solvent").alias("role"), F.col("subject").alias("smiles"))
    formulations = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    entity = B.entity_measurements(spark, sf).withColumn("entity_id", F.col("entity_id").cast("string"))
    # The loop reads lines several times; they meet their parts once.
    listed = cut_lineage(B.listed_lines(spark, sf))
    return D.Graph(mols, formulations, B.listed_components(listed), B.listed_measurements(spark, sf, listed), entity, known, earlier)


def _proposals(spark, sf):
    return D.propose(loop_inputs(spark, sf), min_confidence=MIN_CONF, alpha=ALPHA)


def _evaluated(spark, sf):
    g = loop_inputs(spark, sf)
    proposals = D.propose(g, min_confidence=MIN_CONF, alpha=ALPHA)
    return H.evaluate(proposals, g.molecules, g.relations, ST.property_stats(g.formulation_measurements), validation_threshold=0.2)


SHAPES = "components measurements entity_measurements"


@query("ranked_proposals", "W-107 W-108", with_(SHAPES, """
    SELECT hypothesis_id, subject, predicate, object, round(confidence, 6) AS confidence, round(novelty, 6) AS novelty_score, round(rank_score, 6) AS rank_score FROM ranked""", **LOOP_CTES))
def ranked_proposals(spark, sf):
    out = _proposals(spark, sf).select("hypothesis_id", "subject", "predicate", "object", "confidence", "novelty_score", "rank_score")
    return rounded(out, 6, "confidence", "novelty_score", "rank_score")


@query("best_proposals", "W-108", with_(SHAPES, """
    SELECT hypothesis_id, round(rank_score, 6) AS rank_score FROM ranked ORDER BY ranked.rank_score DESC, hypothesis_id LIMIT 50""", **LOOP_CTES))
def best_proposals(spark, sf):
    """The fifty best, as the loop's limit gives them."""
    best = D.propose(loop_inputs(spark, sf), min_confidence=MIN_CONF, max_hypotheses=50, alpha=ALPHA)
    return rounded(best.select("hypothesis_id", "rank_score"), 6, "rank_score")


@query("proposal_summary", "W-68", with_(SHAPES, """
    SELECT predicate, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, round(avg(novelty), 6) AS avg_novelty FROM ranked GROUP BY 1""", **LOOP_CTES))
def proposal_summary(spark, sf):
    return rounded(SU.proposal_summary(_proposals(spark, sf)), 6, "avg_confidence", "avg_novelty")


@query("evaluated_hypotheses", "W-109 W-110 W-111 W-112 W-48", with_(SHAPES, """
    SELECT hypothesis_id, predicate, round(ps, 6) AS plausibility_score, CASE WHEN cp THEN round(cs, 6) END AS consistency_score, round(sc, 6) AS statistical_score,
           passed AS tests_passed, round(final_confidence, 6) AS final_confidence, status FROM verdicts""", **LOOP_CTES))
def evaluated_hypotheses(spark, sf):
    out = _evaluated(spark, sf).withColumn("consistency_score", F.when(F.col("consistency_passed"), F.col("consistency_score")))
    out = out.select("hypothesis_id", "predicate", "plausibility_score", "consistency_score", "statistical_score", "tests_passed", "final_confidence", "status")
    return rounded(out, 6, "plausibility_score", "consistency_score", "statistical_score", "final_confidence")


@query("merged_evaluation", "W-49", with_(SHAPES, """
    SELECT hypothesis_id, round(final_confidence, 6) AS confidence, round(confidence, 6) AS original_confidence, status FROM verdicts""", **LOOP_CTES))
def merged_evaluation(spark, sf):
    evaluated = _evaluated(spark, sf)
    out = H.merge_evaluation(evaluated.drop("status", "final_confidence"), evaluated)
    return rounded(out.select("hypothesis_id", "confidence", "original_confidence", "status"), 6, "confidence", "original_confidence")


@query("curation_queue", "W-113", with_(SHAPES, """
    SELECT hypothesis_id, status, CASE status WHEN 'validated' THEN 'ready_to_merge' ELSE 'needs_review' END AS action FROM verdicts
    WHERE status = 'validated' OR (status = 'inconclusive' AND final_confidence >= 0.01)""", **LOOP_CTES))
def curation_queue(spark, sf):
    return C.curation_queue(_evaluated(spark, sf), review_from=0.01).select("hypothesis_id", "status", "action")


@query("hypothesis_display", "W-161", with_(SHAPES, """
    SELECT substr(hypothesis_id, 1, 16) || '...' AS id, predicate AS type, substr(replace(subject, 'property:', ''), 1, 30) AS subject, substr(object_name, 1, 30) AS object, status FROM verdicts""", **LOOP_CTES))
def hypothesis_display(spark, sf):
    return H.display_table(_evaluated(spark, sf)).drop("confidence")


LOOP_GAPS = {**LOOP_CTES, **GAP_CTES}
DISCOVERY = """
    SELECT 'gaps_found' AS stage, (SELECT count(*) FROM gaps) AS n UNION ALL SELECT 'hypothesis_candidates', (SELECT count(*) FROM gaps WHERE actionable)
    UNION ALL SELECT 'hypotheses_generated', (SELECT count(*) FROM verdicts) UNION ALL SELECT 'validated', (SELECT count(*) FROM verdicts WHERE status = 'validated')
    UNION ALL SELECT 'rejected', (SELECT count(*) FROM verdicts WHERE status = 'rejected') UNION ALL SELECT 'inconclusive', (SELECT count(*) FROM verdicts WHERE status = 'inconclusive')
    UNION ALL SELECT 'ready_for_curation', (SELECT count(*) FROM verdicts WHERE status = 'validated' OR (status = 'inconclusive' AND final_confidence >= 0.5))"""


def discovery(spark, sf) -> D.Discovery:
    g = loop_inputs(spark, sf)
    entity = B.entity_measurements(spark, sf).select("id", F.concat(F.lit("c"), "entity_id").alias("entity_id"), "property_type", "value")
    lines = B.table(spark, sf, "lineitem").select(
        F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("entity_id"),
        F.lit(None).cast("string").alias("property_type"), F.lit(None).cast("double").alias("value"))
    customers = B.customers(spark, sf).select(F.concat(F.lit("c"), "id").alias("id"), "role", F.col("role").alias("smiles"))
    molecules = customers.unionByName(g.molecules.select("id", F.lit("salt").alias("role"), F.lit(None).cast("string").alias("smiles")))
    formulations = B.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    graph = D.Graph(molecules, formulations, g.components, g.formulation_measurements, entity.unionByName(lines), g.relations, g.proposed)
    return D.run(graph, min_confidence=MIN_CONF, validation_threshold=0.2, alpha=ALPHA, expected=["click", "purchase", "refund"])


@query("discovery_funnel", "W-119 W-67", with_(SHAPES + " customers", DISCOVERY, **LOOP_GAPS))
def discovery_funnel(spark, sf):
    return discovery(spark, sf).funnel


@query("discovery_run_metrics", "W-67 W-119", with_(SHAPES + " customers", """
    SELECT (SELECT count(*) FROM gaps) AS total_gaps, count(*) AS total_hypotheses, count(*) FILTER (status = 'validated') AS validated,
           count(*) FILTER (status = 'validated' OR (status = 'inconclusive' AND final_confidence >= 0.5)) AS ready_for_curation,
           round(count(*) FILTER (status = 'validated') * 1.0 / count(*), 6) AS validation_rate,
           round(count(*) FILTER (status = 'validated') * 1.0 / (SELECT count(*) FROM gaps), 6) AS funnel_conversion FROM verdicts""", **LOOP_GAPS))
def discovery_run_metrics(spark, sf):
    return rounded(D.run_metrics(discovery(spark, sf).funnel), 6, "validation_rate", "funnel_conversion")


# --- curation over the labelled hypotheses ---

CURATE = dict(
    hy="SELECT id AS hypothesis_id, subject, predicate, object, confidence, status FROM hypotheses",
    dec="""SELECT hypothesis_id, CASE status WHEN 'validated' THEN 'approved' WHEN 'rejected' THEN 'rejected' ELSE 'deferred' END AS decision,
           CASE WHEN confidence >= 0.5 THEN 'ann' ELSE 'bob' END AS curator, confidence > 0.9 AS edited FROM hy WHERE status <> 'proposed'""",
    graph="SELECT DISTINCT subject, predicate, object FROM hy WHERE status = 'proposed' AND confidence < 0.1",
    edited="""SELECT hypothesis_id, subject, CASE WHEN edited THEN 'affects' ELSE predicate END AS predicate, object, CASE WHEN edited THEN 0.95 ELSE confidence END AS confidence, curator
              FROM dec JOIN hy USING (hypothesis_id) WHERE decision = 'approved'""",
    merged="""SELECT 'edge-' || substr(md5(subject || ':' || predicate || ':' || object), 1, 12) AS edge_id, * FROM edited
              WHERE (subject, predicate, object) NOT IN (SELECT (subject, predicate, object) FROM graph)
              QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY hypothesis_id) = 1""")


def _curation(spark, sf):
    hyp = B.hypotheses(spark, sf).select(F.col("id").alias("hypothesis_id"), "subject", "predicate", "object", "confidence", "status")
    at = F.lit("2025-01-01").cast("timestamp")
    edits = F.when(F.col("confidence") > 0.9, F.create_map(F.lit("hypothesis_type"), F.lit("affects"), F.lit("confidence"), F.lit("0.95")))
    rows = None
    for status, decision in (("validated", "approved"), ("rejected", "rejected"), ("inconclusive", "deferred")):
        mine = hyp.where(F.col("status") == status)
        for curator, part in (("ann", mine.where("confidence >= 0.5")), ("bob", mine.where("confidence < 0.5"))):
            d = C.decision_rows(part, decision, F.lit("reviewed"), curator, at, edits)
            rows = d if rows is None else rows.unionByName(d)
    graph = hyp.where("status = 'proposed' AND confidence < 0.1")
    return hyp, rows, graph


@query("decision_log", "W-115 W-16", with_("hypotheses", "SELECT hypothesis_id, decision, curator FROM dec", **CURATE))
def decision_log(spark, sf):
    return _curation(spark, sf)[1].select("hypothesis_id", "decision", "curator")


@query("auto_approved", "W-114", with_("hypotheses", """
    SELECT hypothesis_id, 'approved' AS decision, 'auto' AS curator FROM hy WHERE confidence >= 0.7""", **CURATE))
def auto_approved(spark, sf):
    hyp, _, _ = _curation(spark, sf)
    return C.auto_approve(hyp, 0.7, F.lit("2025-01-01").cast("timestamp")).select("hypothesis_id", "decision", "curator")


@query("pending_hypotheses", "W-114", with_("hypotheses", "SELECT hypothesis_id FROM hy WHERE hypothesis_id NOT IN (SELECT hypothesis_id FROM dec)", **CURATE))
def pending_hypotheses(spark, sf):
    hyp, decisions, _ = _curation(spark, sf)
    return C.pending(hyp, decisions).select("hypothesis_id")


@query("merged_edges", "W-116", with_("hypotheses", "SELECT edge_id, subject, predicate, object, hypothesis_id, confidence, curator FROM merged", **CURATE))
def merged_edges(spark, sf):
    hyp, decisions, graph = _curation(spark, sf)
    return C.merge_approved(decisions, hyp, graph).select("edge_id", "subject", "predicate", "object", "hypothesis_id", "confidence", "curator")


@query("merged_edge_provenance", "W-116", with_("hypotheses", """
    SELECT edge_id AS entity_id, 'discovery_pipeline' AS extraction_method, hypothesis_id, hy.confidence AS original_confidence, merged.confidence AS validated_confidence, curator
    FROM merged JOIN hy USING (hypothesis_id)""", **CURATE))
def merged_edge_provenance(spark, sf):
    hyp, decisions, graph = _curation(spark, sf)
    out = C.merge_provenance(C.merge_approved(decisions, hyp, graph), hyp)
    return out.select("entity_id", "extraction_method", "hypothesis_id", "original_confidence", "validated_confidence", "curator")


@query("marked_hypotheses", "W-116", with_("hypotheses", """
    SELECT hypothesis_id, edge_id, edge_id IS NOT NULL AS merged, CASE WHEN edge_id IS NOT NULL THEN 'validated' ELSE status END AS status
    FROM hy LEFT JOIN (SELECT hypothesis_id, edge_id FROM merged) USING (hypothesis_id)""", **CURATE))
def marked_hypotheses(spark, sf):
    hyp, decisions, graph = _curation(spark, sf)
    return C.mark_merged(hyp, C.merge_approved(decisions, hyp, graph)).select("hypothesis_id", "edge_id", "merged", "status")


@query("negative_evidence", "W-117", with_("hypotheses", """
    SELECT hypothesis_id, subject, predicate, object, curator AS rejected_by, 'rejected' AS status FROM dec JOIN hy USING (hypothesis_id) WHERE decision = 'rejected'""", **CURATE))
def negative_evidence(spark, sf):
    hyp, decisions, _ = _curation(spark, sf)
    return C.negative_evidence(decisions, hyp).select("hypothesis_id", "subject", "predicate", "object", "rejected_by", "status")


@query("curation_summary", "W-69", with_("hypotheses", """
    SELECT d AS metric, count(dec.hypothesis_id) AS n FROM (VALUES ('approved'), ('rejected'), ('deferred')) v(d) LEFT JOIN dec ON decision = d GROUP BY 1
    UNION ALL SELECT 'total_decisions', count(*) FROM dec UNION ALL SELECT 'merged_edges', count(*) FROM merged
    UNION ALL SELECT 'pending_review', count(*) FROM hy WHERE hypothesis_id NOT IN (SELECT hypothesis_id FROM dec)""", **CURATE))
def curation_summary(spark, sf):
    hyp, decisions, graph = _curation(spark, sf)
    return C.curation_summary(decisions, C.merge_approved(decisions, hyp, graph), C.pending(hyp, decisions))


VALID = dict(
    v="""SELECT 'hyp-' || doc_id AS id, CASE WHEN quality = 1 THEN 'validated' ELSE 'rejected' END AS status, 'ablation' AS method, 0.5::DOUBLE AS lift, 1 AS seq FROM labels
         UNION ALL SELECT 'hyp-' || doc_id, 'rejected', 'review', 0.1::DOUBLE, 2 FROM labels WHERE toxic = 1""")


def _validations(spark, sf):
    labels = B.table(spark, sf, "labels")
    row = lambda df, status, method, lift, at: df.select(
        F.concat(F.lit("hyp-"), "doc_id").alias("id"), status.alias("status"), F.lit(method).alias("method"), F.lit(lift).alias("model_lift"),
        F.lit(at).alias("at"), F.array(F.concat(F.lit(f"{method}-"), "doc_id")).alias("evidence"))
    first = row(labels, F.when(F.col("quality") == 1, "validated").otherwise("rejected"), "ablation", 0.5, 1)
    return first.unionByName(row(labels.where("toxic = 1"), F.lit("rejected"), "review", 0.1, 2))


@query("applied_validations", "W-118", with_("hypotheses", """
    SELECT h.id, coalesce(l.status, h.status) AS status, l.method AS validated_by, CASE WHEN l.id IS NULL THEN model_lift ELSE l.lift END AS model_lift, coalesce(l.n, 0) AS n_validations
    FROM hypotheses h LEFT JOIN (SELECT id, arg_max(status, seq) AS status, arg_max(method, seq) AS method, arg_max(lift, seq) AS lift, count(*) AS n FROM v GROUP BY 1) l ON l.id = h.id""", **VALID))
def applied_validations(spark, sf):
    return C.apply_validations(B.hypotheses(spark, sf), _validations(spark, sf)).select("id", "status", "validated_by", "model_lift", "n_validations")


@query("validation_evidence", "W-118", """
    SELECT 'hyp-' || doc_id AS id, CASE WHEN quality = 1 THEN 'supporting' ELSE 'contradicting' END AS side, 'ablation-' || doc_id AS evidence FROM labels
    UNION ALL SELECT 'hyp-' || doc_id, 'contradicting', 'review-' || doc_id FROM labels WHERE toxic = 1""")
def validation_evidence(spark, sf):
    return C.evidence_rows(_validations(spark, sf))


@query("merged_validated", "W-118", with_("hypotheses", """
    SELECT subject, predicate, object, h.id AS entity_id, 'hypothesis_validation:' || source AS extraction_method, confidence, validated_by AS validation_method
    FROM hypotheses h JOIN (SELECT id, arg_max(status, seq) AS status, arg_max(method, seq) AS validated_by FROM v GROUP BY 1) l ON l.id = h.id WHERE l.status = 'validated'""", **VALID))
def merged_validated(spark, sf):
    updated = C.apply_validations(B.hypotheses(spark, sf), _validations(spark, sf))
    return C.merge_validated(updated).select("subject", "predicate", "object", "entity_id", "extraction_method", "confidence", "validation_method")
