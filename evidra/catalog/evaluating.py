"""Evaluation, time-slice, ablation and link-prediction queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from evidra import bindings as B
from evidra.catalog import query
from evidra.catalog.common import rounded
from evidra.catalog.sqlparts import t_tail, with_
from evidra.operators import evaluation as E, linkpred as L, relational as R

RANKS = "SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events"


@query("ranking_metrics", "W-98", f"""
    SELECT event_type, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_1,
           round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_10, count(*) AS num_queries
    FROM ({RANKS}) GROUP BY event_type""")
def ranking_metrics(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranks = B.table(spark, sf, "events").withColumn("rank", F.row_number().over(w))
    return rounded(E.ranking_metrics(ranks, by=("event_type",)), 6, "mrr", "hits_at_1", "hits_at_3", "hits_at_10")


@query("regression_metrics", "W-99", """
    SELECT l_returnflag, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS num_samples
    FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS e FROM lineitem) GROUP BY 1""")
def regression_metrics(spark, sf):
    pairs = B.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    return rounded(rounded(E.regression_metrics(pairs, "y", "p", ("l_returnflag",)), 4, "rmse", "mae"), 6, "r2")


DATED = dict(
    pub="SELECT id, CASE WHEN first_doc % 2 = 0 THEN DATE '2021-06-01' + CAST(first_doc AS INTEGER) END AS published_on FROM sources",
    dated="""SELECT h.subject, h.predicate, h.object, coalesce(pub.published_on, p.created_on) AS edge_date FROM hypotheses h
             JOIN provenance p ON p.id = 'prov:' || substr(h.id, 5) LEFT JOIN pub ON pub.id = p.source_ids[1] WHERE h.status <> 'inconclusive'""",
    first_seen="SELECT subject, predicate, object, min(edge_date) AS first_seen FROM dated GROUP BY ALL",
    ranked="SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS rank FROM hypotheses")


def dated_edges(spark, sf):
    h = B.hypotheses(spark, sf).where("status <> 'inconclusive'")
    edges = h.select(*R.SPO, F.concat(F.lit("prov:"), F.substring("id", 5, 20)).alias("provenance_id"))
    src = B.sources(spark, sf).select("id", F.when(F.col("first_doc") % 2 == 0, F.date_add(F.lit("2021-06-01").cast("date"), F.col("first_doc").cast("int"))).alias("published_on"))
    return E.edge_dates(edges, B.provenance(spark, sf), src)


@query("time_split", "W-101", with_("hypotheses provenance sources", """
    SELECT subject, predicate, object, strftime(first_seen, '%Y-%m-%d') AS first_seen, CASE WHEN first_seen > DATE '2021-06-30' THEN 'post' ELSE 'pre' END AS slice FROM first_seen""", **DATED))
def time_split(spark, sf):
    return E.time_split(E.first_seen(dated_edges(spark, sf)), "2021-06-30").withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd"))


@query("time_slice_ranks", "W-100", with_("hypotheses provenance sources", """
    SELECT r.id, rank, f.subject IS NOT NULL AS hit, CASE WHEN f.subject IS NOT NULL THEN 'validated' ELSE status END AS status FROM ranked r
    LEFT JOIN (SELECT * FROM first_seen WHERE first_seen > DATE '2021-06-30') f USING (subject, predicate, object)""", **DATED))
def time_slice_ranks(spark, sf):
    post = E.time_split(E.first_seen(dated_edges(spark, sf)), "2021-06-30").where("slice = 'post'")
    return E.mark_time_slice(E.rank_by_confidence(B.hypotheses(spark, sf)), post).select("id", "rank", "hit", "status")


CUTS = ["2020-06-30", "2021-06-30", "2022-06-30"]
SLICES = " UNION ALL ".join(f"""
    SELECT '{c}' AS cutoff, count(*) AS num_hypotheses, count(f.subject) AS num_appeared_after, count(f.subject) * 1.0 / count(*) AS hit_rate,
           coalesce(avg(rank) FILTER (f.subject IS NOT NULL), 'inf'::DOUBLE) AS avg_rank, coalesce(avg(1.0 / rank) FILTER (f.subject IS NOT NULL), 0) AS mrr
    FROM ranked r LEFT JOIN (SELECT * FROM first_seen WHERE first_seen > DATE '{c}') f USING (subject, predicate, object)""" for c in CUTS)


@query("time_slice_results", "W-100 W-101", with_("hypotheses provenance sources", f"""
    SELECT cutoff, num_hypotheses, num_appeared_after, round(hit_rate, 6) AS hit_rate, round(avg_rank, 4) AS avg_rank, round(mrr, 6) AS mrr FROM ({SLICES})""", **DATED))
def time_slice_results(spark, sf):
    out = E.time_slice_experiment(B.hypotheses(spark, sf), dated_edges(spark, sf), CUTS)
    return rounded(rounded(out, 6, "hit_rate", "mrr"), 4, "avg_rank")


@query("time_slice_summary", "W-75", with_("hypotheses provenance sources", f"""
    SELECT count(*) AS num_evaluations, round(avg(hit_rate), 6) AS avg_hit_rate, round(avg(mrr), 6) AS avg_mrr, CAST(sum(num_appeared_after) AS BIGINT) AS total_validated FROM ({SLICES})""", **DATED))
def time_slice_summary(spark, sf):
    out = E.time_slice_summary(E.time_slice_experiment(B.hypotheses(spark, sf), dated_edges(spark, sf), CUTS))
    return rounded(out, 6, "avg_hit_rate", "avg_mrr")


MONTHS = [f"{year}-{month:02d}-01" for year in range(2017, 2025) for month in range(1, 13)]


@query("monthly_time_slices", "W-75 W-100 W-101", with_("hypotheses provenance sources", """
    SELECT strftime(c, '%Y-%m-%d') AS cutoff, count(*) AS num_hypotheses, count(*) FILTER (first_seen > c) AS num_appeared_after,
           round(count(*) FILTER (first_seen > c) * 1.0 / count(*), 6) AS hit_rate, round(coalesce(avg(rank) FILTER (first_seen > c), 'inf'::DOUBLE), 4) AS avg_rank,
           round(coalesce(avg(1.0 / rank) FILTER (first_seen > c), 0), 6) AS mrr
    FROM (SELECT rank, first_seen FROM ranked LEFT JOIN first_seen USING (subject, predicate, object)),
         (SELECT unnest(generate_series(DATE '2017-01-01', DATE '2024-12-01', INTERVAL 1 MONTH))::DATE AS c) GROUP BY c""", **DATED))
def monthly_time_slices(spark, sf):
    out = E.time_slice_experiment(B.hypotheses(spark, sf), dated_edges(spark, sf), MONTHS)
    return rounded(rounded(out, 6, "hit_rate", "mrr"), 4, "avg_rank")


FEATURES = dict(
    lastly="""SELECT formulation_id, molecule_id, amount FROM components QUALIFY row_number() OVER (PARTITION BY formulation_id, molecule_id ORDER BY position DESC, amount DESC) = 1""",
    cols="SELECT molecule_id, row_number() OVER (ORDER BY molecule_id) - 1 AS i FROM (SELECT DISTINCT molecule_id FROM components)")


def _features(spark, sf):
    labels = E.first_labels(B.order_measurements(spark, sf), "totalprice")
    return E.feature_matrix(B.components(spark, sf), labels)


@query("feature_matrix", "W-102", with_("components", "SELECT o_orderkey AS formulation_id, o_totalprice AS label, " + ", ".join(
    f"coalesce(max(amount) FILTER (i = {i}), 0) AS c_{i}" for i in range(25)) + """
    FROM orders LEFT JOIN lastly ON formulation_id = o_orderkey LEFT JOIN cols USING (molecule_id) GROUP BY o_orderkey, o_totalprice""", **FEATURES))
def feature_matrix(spark, sf):
    return _features(spark, sf)


@query("ablation_study", "W-103 W-104")
def ablation_study(spark, sf):
    forest = RandomForestRegressor(numTrees=5, maxDepth=4, seed=42)
    errors = E.ablation_errors(_features(spark, sf), [("brand_first", 0), ("unknown", None)], n_folds=3, estimator=forest)
    return E.ablation_results(errors)


@query("sparse_feature_rows", "W-102", with_("components", """
    SELECT o_orderkey AS formulation_id, o_totalprice AS label, count(amount) AS n_features,
           coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (amount IS NOT NULL), '') AS indices, round(coalesce(sum(amount * (i + 1)), 0), 4) AS weighted
    FROM orders LEFT JOIN lastly ON formulation_id = o_orderkey LEFT JOIN cols USING (molecule_id) GROUP BY o_orderkey, o_totalprice""", **FEATURES))
def sparse_feature_rows(spark, sf):
    rows = E.sparse_features(B.components(spark, sf), E.first_labels(B.order_measurements(spark, sf), "totalprice"))[1]
    weighted = F.aggregate(F.zip_with("indices", "amounts", lambda i, a: a * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    out = rows.select("formulation_id", "label", F.size("indices").cast("bigint").alias("n_features"), F.array_join("indices", ",").alias("indices"), weighted.alias("weighted"))
    return rounded(out, 4, "weighted")


#: Columns of the linear fits in SQL: 0 the constant, 1 to 25 the components, 26 the hypothesis' indicator, 27 the label.
LINEAR = dict(
    FEATURES,
    asked="""SELECT molecule_id, 'h:' || molecule_id AS hypothesis_id, count(DISTINCT formulation_id) AS confidence FROM components GROUP BY 1
             QUALIFY row_number() OVER (ORDER BY confidence DESC, hypothesis_id) <= 5 UNION ALL SELECT NULL, 'base', 0""",
    x="""SELECT o_orderkey AS f, 0 AS j, 1.0::DOUBLE AS v FROM orders UNION ALL SELECT o_orderkey, 27, o_totalprice FROM orders
         UNION ALL SELECT formulation_id, i + 1, amount FROM lastly JOIN cols USING (molecule_id) WHERE formulation_id IN (SELECT o_orderkey FROM orders)""",
    xh="""SELECT hypothesis_id AS h, f, j, v FROM asked, x UNION ALL
          SELECT hypothesis_id, formulation_id, 26, 1 FROM lastly JOIN asked USING (molecule_id) WHERE amount > 0""",
    own="SELECT a.h, a.f % 4 AS fold, a.j AS i, b.j AS j, sum(a.v * b.v) AS s FROM xh a JOIN xh b ON a.h = b.h AND a.f = b.f GROUP BY ALL",
    grid="SELECT h, fold, i, j FROM (SELECT DISTINCT h FROM xh), range(4) a(fold), range(28) b(i), range(28) c(j)",
    grams="SELECT h, fold, i, j, coalesce(s, 0) AS s, sum(coalesce(s, 0)) OVER (PARTITION BY h, i, j) - coalesce(s, 0) AS rest FROM grid LEFT JOIN own USING (h, fold, i, j)",
    el="""SELECT h, fold, 0 AS k, i, j, rest + CASE WHEN i = j THEN 0.001 ELSE 0 END AS v FROM grams WHERE i <= 26 UNION ALL
          SELECT e.h, e.fold, e.k + 1, e.i, e.j, CASE WHEN e.i = e.k THEN e.v / p.v ELSE e.v - c.v * r.v / p.v END
          FROM el e JOIN el p ON p.h = e.h AND p.fold = e.fold AND p.i = e.k AND p.j = e.k JOIN el r ON r.h = e.h AND r.fold = e.fold AND r.i = e.k AND r.j = e.j
          JOIN el c ON c.h = e.h AND c.fold = e.fold AND c.i = e.i AND c.j = e.k WHERE e.k < 27""",
    w="SELECT h, fold, i, -v AS w FROM el WHERE k = 27 AND j = 27 UNION ALL SELECT DISTINCT h, fold, 27, 1.0 FROM grams",
    errors="""SELECT h, fold, sqrt(sum(a.w * b.w * s) / max(s) FILTER (i = 0 AND j = 0)) AS e
              FROM grams JOIN w a USING (h, fold, i) JOIN (SELECT h, fold, i AS j, w FROM w) b USING (h, fold, j) GROUP BY ALL""",
    folds="SELECT a.h AS hypothesis_id, a.fold, b.e AS a, a.e AS b FROM errors a JOIN errors b ON b.fold = a.fold AND b.h = 'base' WHERE a.h <> 'base'")


def _linear(spark, sf):
    components = B.components(spark, sf)
    hypotheses = components.groupBy("molecule_id").agg(F.count_distinct("formulation_id").alias("confidence"))
    hypotheses = hypotheses.withColumn("hypothesis_id", F.concat(F.lit("h:"), "molecule_id"))
    top = hypotheses.orderBy(F.desc("confidence"), "hypothesis_id").limit(5)
    return components, E.first_labels(B.order_measurements(spark, sf), "totalprice"), top


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("linear_ablation_errors", "W-103", _recursive(with_("components", """
    SELECT hypothesis_id, fold, round(a, 2) AS baseline_rmse, round(b, 2) AS with_edge_rmse FROM folds""", **LINEAR)))
def linear_ablation_errors(spark, sf):
    out = E.linear_errors(*_linear(spark, sf), n_folds=4, fold=F.col("formulation_id") % 4)
    return rounded(out.withColumn("fold", F.col("fold").cast("bigint")), 2, "baseline_rmse", "with_edge_rmse")


@query("linear_ablation", "W-103 W-104", _recursive(with_("components", f"""
    SELECT hypothesis_id, round(a, 2) AS baseline_rmse, round(b, 2) AS with_edge_rmse, k AS num_folds, round(b - a, 2) AS delta_rmse, round((a - b) / a, 6) AS relative_improvement,
           round({{p}}, 4) AS p_value, {{p}} < 0.05 AND b < a AS is_significant, round(greatest(a - b, 0), 2) AS model_lift,
           CASE WHEN {{p}} < 0.05 AND b < a THEN 'validated' WHEN b - a > 0.05 * a THEN 'rejected' ELSE 'proposed' END AS status FROM r""".replace("{p}", "p"),
    **LINEAR, r0="SELECT hypothesis_id, avg(a) AS a, avg(b) AS b, count(*) AS k, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM folds GROUP BY 1",
    r=f"SELECT *, {t_tail('t', '(k - 1)')} AS p FROM r0")))
def linear_ablation(spark, sf):
    out = E.linear_ablation(*_linear(spark, sf), n_folds=4, top_k=5, fold=F.col("formulation_id") % 4).drop("t")
    return rounded(rounded(rounded(out, 2, "baseline_rmse", "with_edge_rmse", "delta_rmse", "model_lift"), 6, "relative_improvement"), 4, "p_value")


FOLDS = """SELECT l_returnflag || l_linestatus AS hypothesis_id, l_linenumber AS fold, avg(l_quantity) AS a, avg(l_quantity * (1 - l_discount / 10)) AS b FROM lineitem GROUP BY ALL"""


def _folds(spark, sf):
    return B.table(spark, sf, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("hypothesis_id"), F.col("l_linenumber").alias("fold")).agg(
        F.avg("l_quantity").alias("baseline_rmse"), F.avg(F.col("l_quantity") * (1 - F.col("l_discount") / 10)).alias("with_edge_rmse"))


RESULTS = """SELECT hypothesis_id, avg(a) AS a, avg(b) AS b, count(*) AS k, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM folds GROUP BY 1"""


@query("ablation_results", "W-103", f"""
    WITH folds AS ({FOLDS}), r AS ({RESULTS})
    SELECT hypothesis_id, round(a, 6) AS baseline_rmse, round(b, 6) AS with_edge_rmse, k AS num_folds, round(b - a, 6) AS delta_rmse, round(t, 3) AS t,
           round((a - b) / a, 6) AS relative_improvement, b < a AS is_significant, round(greatest(a - b, 0), 6) AS model_lift, 'validated' AS status FROM r""")
def ablation_results(spark, sf):
    out = E.ablation_results(_folds(spark, sf)).drop("p_value")
    return rounded(rounded(out, 6, "baseline_rmse", "with_edge_rmse", "delta_rmse", "relative_improvement", "model_lift"), 3, "t")


@query("ablation_summary", "W-74", f"""
    WITH folds AS ({FOLDS}), r AS ({RESULTS})
    SELECT count(*) AS num_studies, count(*) FILTER (b < a) AS num_significant, round(avg(b - a), 6) AS avg_delta_rmse,
           round(avg((a - b) / a) FILTER (b < a), 6) AS avg_improvement, round(max((a - b) / a) FILTER (b < a), 6) AS best_improvement FROM r""")
def ablation_summary(spark, sf):
    out = E.ablation_summary(E.ablation_results(_folds(spark, sf)))
    return rounded(out, 6, "avg_delta_rmse", "avg_improvement", "best_improvement")


# --- link prediction ---


@query("dense_entity_ids", "W-92", with_("relations", """
    SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS idx FROM (SELECT subject AS entity FROM relations UNION SELECT object FROM relations)"""))
def dense_entity_ids(spark, sf):
    return L.entity_ids(B.relations(spark, sf))


@query("encoded_triples", "W-92", with_("relations", """
    SELECT a.idx AS h, p.idx AS r, b.idx AS t, count(*) AS copies FROM relations JOIN e a ON a.entity = subject JOIN e b ON b.entity = object JOIN pr p USING (predicate) GROUP BY ALL""",
    e="SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS idx FROM (SELECT subject AS entity FROM relations UNION SELECT object FROM relations)",
    pr="SELECT predicate, row_number() OVER (ORDER BY predicate) - 1 AS idx FROM (SELECT DISTINCT predicate FROM relations)"))
def encoded_triples(spark, sf):
    return L.encode_triples(B.relations(spark, sf))[2].groupBy("h", "r", "t").agg(F.count("*").alias("copies"))


VECTORS = dict(
    ent="SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vec, 'label' || label AS predicate FROM embeddings",
    rel="""SELECT predicate, list(v ORDER BY i) AS rvec FROM (SELECT predicate, i, avg(vec[i]) AS v FROM ent, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1""",
    q="SELECT id AS subject, predicate, list_transform(list_zip(vec, rvec), lambda z: z[1] + z[2]) AS qv, list_transform(list_zip(vec, rvec), lambda z: z[1] - z[2]) AS hv FROM ent JOIN rel USING (predicate)",
    tails="""SELECT subject, q.predicate, ent.id AS object, -list_distance(qv, vec) AS score, row_number() OVER (PARTITION BY subject, q.predicate ORDER BY list_distance(qv, vec), ent.id) AS rank
             FROM q, ent WHERE ent.id <> subject QUALIFY rank <= 5""")


def vectors(spark, sf):
    """Embeddings as entity vectors and label means as relation vectors."""
    ent = B.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.concat(F.lit("label"), "label").alias("predicate"))
    mean = F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(64)])
    return ent, ent.groupBy(F.col("predicate").alias("id")).agg(mean.alias("vec"))


@query("triple_scores", "W-94", with_("", """
    SELECT a.id AS subject, a.predicate, b.id AS object, round(-list_distance(qv, b.vec), 6) AS score
    FROM ent a JOIN q ON q.subject = a.id JOIN ent b ON CAST(b.id AS BIGINT) = CAST(a.id AS BIGINT) + 1""", **VECTORS))
def triple_scores(spark, sf):
    ent, rel = vectors(spark, sf)
    following = ent.select("id", F.col("id").alias("subject"), "predicate", (F.col("id").cast("bigint") + 1).cast("string").alias("object"))
    known = following.join(ent.select(F.col("id").alias("object")), "object", "left_semi")
    out = L.score_triples(known.select("subject", "predicate", "object"), ent, rel)
    return rounded(out, 6, "score").select("subject", "predicate", "object", "score")


@query("predicted_tails", "W-95", with_("", "SELECT subject, predicate, object, round(score, 5) AS score, rank FROM tails", **VECTORS))
def predicted_tails(spark, sf):
    ent, rel = vectors(spark, sf)
    out = L.predict_tails(ent.select(F.col("id").alias("subject"), "predicate"), ent, rel, 5)
    return rounded(out, 5, "score").withColumn("rank", F.col("rank").cast("bigint"))


@query("predicted_heads", "W-95", with_("", """
    SELECT q.subject AS object, q.predicate, ent.id AS subject, round(-list_distance(hv, vec), 5) AS score FROM q, ent WHERE ent.id <> q.subject
    QUALIFY row_number() OVER (PARTITION BY q.subject, q.predicate ORDER BY list_distance(hv, vec), ent.id) <= 3""", **VECTORS))
def predicted_heads(spark, sf):
    ent, rel = vectors(spark, sf)
    out = L.predict_heads(ent.select(F.col("id").alias("object"), "predicate"), ent, rel, 3)
    return rounded(out.drop("rank"), 5, "score")


@query("link_candidates", "W-96 W-97", with_("", """
    SELECT subject, alltails.predicate, object, round(score, 5) AS score, round(1 / (1 + exp(-score)), 5) AS confidence,
           CASE WHEN s.predicate < 'label5' THEN 'Solvent' ELSE 'Unknown' END AS subject_type, CASE WHEN o.predicate < 'label5' THEN 'Solvent' ELSE 'Unknown' END AS object_type
    FROM alltails JOIN ent s ON s.id = subject JOIN ent o ON o.id = object WHERE NOT EXISTS (SELECT 1 FROM ent a, ent b WHERE a.id = subject AND b.id = object AND a.predicate = b.predicate AND a.predicate = alltails.predicate)""",
    ent=VECTORS["ent"], rel=VECTORS["rel"],
    q="SELECT id AS subject, rel.predicate, list_transform(list_zip(vec, rvec), lambda z: z[1] + z[2]) AS qv FROM ent, rel WHERE rel.predicate IN ('label1', 'label2')",
    alltails="""SELECT subject, q.predicate, ent.id AS object, -list_distance(qv, vec) AS score FROM q, ent WHERE ent.id <> subject
                QUALIFY row_number() OVER (PARTITION BY subject, q.predicate ORDER BY list_distance(qv, vec), ent.id) <= 5"""))
def link_candidates(spark, sf):
    ent, rel = vectors(spark, sf)
    # Known edges: members of label l are linked by l; written as a semi-join friendly pair table.
    mine = ent.where(F.col("predicate").isin("label1", "label2")).select("id", "predicate")
    found = L.generate_candidates(
        mine.select(F.col("id").alias("subject"), "predicate", F.col("id").alias("object")), ent.select("id", "vec"), rel,
        types=ent.where("predicate < 'label5'").select("id", F.lit("Solvent").alias("entity_type")), predicates=["label1", "label2"], top_k=5)
    s, o = mine.select(F.col("id").alias("subject"), "predicate"), mine.select(F.col("id").alias("object"), "predicate")
    inside = found.join(s, ["subject", "predicate"], "left_semi").join(o, ["object", "predicate"], "left_semi")
    fresh = found.join(inside.select(*R.SPO), R.SPO, "left_anti")
    return rounded(fresh.select("subject", "predicate", "object", "score", "confidence", "subject_type", "object_type"), 5, "score", "confidence")


@query("entity_types", "W-97", """
    SELECT CAST(k AS VARCHAR) AS id, arg_min(t, r) AS entity_type FROM (SELECT o_orderkey AS k, 'ElectrolyteFormulation' AS t, 0 AS r FROM orders
      UNION ALL SELECT p_partkey, 'Solvent', 1 FROM part UNION ALL SELECT event_id, 'PropertyMeasurement', 5 FROM events) GROUP BY 1""")
def entity_types(spark, sf):
    pick = lambda t, c: B.table(spark, sf, t).select(F.col(c).alias("id"), F.lit(None).cast("string").alias("name"))
    return R.entity_lookup([
        ("ElectrolyteFormulation", pick("orders", "o_orderkey")), ("Solvent", pick("part", "p_partkey")), ("PropertyMeasurement", pick("events", "event_id")),
    ]).select("id", "entity_type")


def _training_sql(dim: int, rate: float, margin: float | None = None, epochs: int = 2) -> str:
    """Losses of the first epochs, one row of a vector per position, from the same md5 digits."""
    digits = "('0x' || substr(md5({}), 1, 8))::BIGINT"
    start = f"SELECT id, i, {digits.format("{seed} || ':' || id || ':' || i")} / 2147483648.0 - 1 AS x FROM {{ids}}, range({dim}) d(i)"
    unit = "SELECT id, i, x / CASE WHEN sum(x * x) OVER (PARTITION BY id) > 0 THEN sqrt(sum(x * x) OVER (PARTITION BY id)) ELSE 1 END AS x FROM ({})"
    parts = {
        "e": "SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT subject AS entity FROM relations UNION SELECT object FROM relations)",
        "p": "SELECT predicate, row_number() OVER (ORDER BY predicate) - 1 AS id FROM (SELECT DISTINCT predicate FROM relations)",
        "ed": "SELECT a.id AS h, p.id AS r, b.id AS t, count(*) AS w FROM relations JOIN e a ON a.entity = subject JOIN e b ON b.entity = object JOIN p USING (predicate) GROUP BY ALL",
        "v0": unit.format(start.format(seed=42, ids="e")), "r0": start.format(seed=43, ids="p"),
    }
    losses = []
    for k in range(1, epochs + 1):
        drawn = digits.format(f"h || ':' || r || ':' || t || ':{k}'")
        wrong = f"(t + 1 + {drawn} % ((SELECT count(*) FROM e) - 1)) % (SELECT count(*) FROM e)" if margin else "t"
        parts[f"n{k}"] = f"SELECT *, {wrong} AS c FROM ed"
        v, r = f"v{k - 1}", f"r{k - 1}"
        parts[f"s{k}"] = f"""SELECT h, r, t, c, w, a.i, a.x + b.x - d.x AS e, a.x + b.x - f.x AS f FROM n{k} JOIN {v} a ON a.id = h JOIN {r} b ON b.id = r AND b.i = a.i
            JOIN {v} d ON d.id = t AND d.i = a.i JOIN {v} f ON f.id = c AND f.i = a.i"""
        loss = f"greatest(0, {margin} + sum(e * e) - sum(f * f))" if margin else "sum(e * e)"
        parts[f"h{k}"] = f"SELECT h, r, t, c, w, {loss} AS loss FROM s{k} GROUP BY ALL"
        losses.append(f"SELECT {k} AS epoch, round(sum(loss * w) / sum(w), 6) AS loss FROM h{k}")
        ends = [(0, "h", "2 * (e - f)"), (0, "t", "-2 * e"), (0, "c", "2 * f"), (1, "r", "2 * (e - f)")] if margin else [(0, "h", "2 * e"), (0, "t", "-2 * e"), (1, "r", "2 * e")]
        parts[f"g{k}"] = f"SELECT kind, id, i, sum(g * w) / sum(w) AS g FROM (" + " UNION ALL ".join(
            f"SELECT {kind} AS kind, {end} AS id, i, {g} AS g, w FROM s{k} JOIN h{k} USING (h, r, t, c, w) WHERE loss > 0" for kind, end, g in ends) + ") GROUP BY ALL"
        moved = f"SELECT o.id, o.i, o.x - {rate} * coalesce(g, 0) AS x FROM {{}} o LEFT JOIN g{k} g ON g.kind = {{}} AND g.id = o.id AND g.i = o.i"
        parts[f"v{k}"], parts[f"r{k}"] = unit.format(moved.format(v, 0)), moved.format(r, 1)
    return with_("relations", " UNION ALL ".join(losses), **parts)


@query("translation_training", "W-93", _training_sql(8, 0.1))
def translation_training(spark, sf):
    """Loss per epoch over the whole edge table."""
    _, _, edges = L.encode_triples(B.relations(spark, sf))
    _, _, losses = L.train_transe(edges, dim=8, epochs=2, learning_rate=0.1, initial=L.digit_vectors)
    rows = [spark.range(1).select(F.lit(i + 1).alias("epoch"), F.round(F.lit(v), 6).alias("loss")) for i, v in enumerate(losses)]
    return reduce(DataFrame.unionByName, rows)


@query("margin_training", "W-93", _training_sql(8, 0.1, margin=1.0))
def margin_training(spark, sf):
    """Ranking loss per epoch against one wrong tail for each edge."""
    entities, _, edges = L.encode_triples(B.relations(spark, sf))
    return rounded(L.train_margin(edges, entities.count(), dim=8, epochs=2, learning_rate=0.1)[2], 6, "loss")
