"""Mining and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra import bindings as B
from evidra.catalog import query
from evidra.catalog.common import rounded
from evidra.catalog.sqlparts import t_tail, with_
from evidra.functions import scalar as S
from evidra.operators import mining as M, stats as ST

MULT = "SELECT formulation_id, molecule_id, count(*) AS m FROM components GROUP BY ALL"


@query("property_stats", "W-61", with_("measurements", """
    SELECT property_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max,
           count(*) AS n, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3
    FROM measurements GROUP BY property_type HAVING count(*) >= 5"""))
def property_stats(spark, sf):
    return rounded(ST.property_stats(B.measurements(spark, sf)), 4, "mean", "std", "q1", "q3")


@query("entity_property_means", "W-62", with_("entity_measurements", """
    SELECT entity_id, property_type, round(avg(value) + 1e-9, 4) AS mean_value, count(*) AS n
    FROM entity_measurements GROUP BY ALL"""))
def entity_property_means(spark, sf):
    # Means of two-decimal values may end exactly on a rounding half; both sides step off it.
    means = ST.entity_property_means(B.entity_measurements(spark, sf))
    return rounded(means.withColumn("mean_value", F.col("mean_value") + 1e-9), 4, "mean_value")


@query("dominant_component_stats", "W-63", """
    WITH w AS (SELECT l_orderkey, p_brand, sum(l_quantity) AS q, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    s AS (SELECT *, q / sum(q) OVER (PARTITION BY l_orderkey) AS fraction, sum(v) OVER (PARTITION BY l_orderkey) AS k FROM w)
    SELECT p_brand AS component, round(avg(k), 4) AS mean, round(stddev_samp(k), 4) AS std, round(min(k), 4) AS min,
           round(max(k), 4) AS max, count(*) AS count
    FROM s WHERE fraction > 0.5 GROUP BY p_brand""")
def dominant_component_stats(spark, sf):
    lines = B.table(spark, sf, "lineitem").join(
        B.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = [f"Brand#{i}" for i in range(1, 26)]
    total = F.sum("l_quantity")
    fractions = [(F.sum(F.when(F.col("p_brand") == b, F.col("l_quantity")).otherwise(0.0)) / total).alias(b) for b in brands]
    wide = lines.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("k"), *fractions)
    return rounded(ST.dominant_component_stats(wide, brands, "k"), 4, "mean", "std", "min", "max")


@query("presence_effects", "W-43 W-76", with_("components measurements", """
    SELECT molecule_id AS component_id, 'extendedprice' AS property_type,
           CASE WHEN effect > 0 THEN 'increases' ELSE 'decreases' END AS effect, round(effect, 6) AS correlation,
           CAST(n_with AS BIGINT) AS num_samples, CAST(n_without AS BIGINT) AS n_without, round(mean_with, 4) AS mean_with, round(mean_without, 4) AS mean_without
    FROM (SELECT *, (mean_with - mean_without) / (sd + 1e-8) AS effect FROM (
        SELECT molecule_id, sum(m * fn) AS n_with, any_value(n) - sum(fn) AS n_without, sum(m * fs) / sum(m * fn) AS mean_with,
               (any_value(s) - sum(fs)) / (any_value(n) - sum(fn)) AS mean_without, any_value(sd) AS sd
        FROM mult JOIN f USING (formulation_id), tot GROUP BY molecule_id))
    WHERE n_with >= 5 AND n_without >= 5 AND abs(effect) >= 0.0""",
    mult=MULT,
    f="SELECT formulation_id, count(*) AS fn, sum(value) AS fs FROM measurements WHERE property_type = 'extendedprice' GROUP BY 1",
    tot="SELECT count(*) AS n, sum(value) AS s, stddev_pop(value) AS sd FROM measurements WHERE property_type = 'extendedprice'"))
def presence_effects(spark, sf):
    out = M.presence_effects(B.components(spark, sf), B.line_measurements(spark, sf), "extendedprice", min_correlation=0.0)
    return rounded(rounded(out, 6, "correlation"), 4, "mean_with", "mean_without")


@query("amount_correlations", "W-77", with_("components measurements", """
    SELECT molecule_id AS component_id, 'extendedprice' AS property_type,
           CASE WHEN r > 0 THEN 'increases' ELSE 'decreases' END AS effect,
           CASE WHEN abs(r) > 0.3 THEN 'strongly' WHEN abs(r) > 0.2 THEN 'moderately' ELSE 'weakly' END AS strength,
           round(r, 6) AS correlation, n AS num_samples, round(mx, 4) AS mean_with, 0.0::DOUBLE AS mean_without
    FROM (SELECT molecule_id, corr(coalesce(a, 0), value) AS r, count(*) AS n, avg(coalesce(a, 0)) AS mx, stddev_pop(coalesce(a, 0)) AS sx
          FROM mol CROSS JOIN rows_ LEFT JOIN amounts USING (formulation_id, molecule_id) GROUP BY molecule_id)
    WHERE n >= 10 AND sx >= 1e-6 AND abs(r) >= 0.0""",
    amounts="""SELECT formulation_id, molecule_id, amount AS a FROM components
               QUALIFY row_number() OVER (PARTITION BY formulation_id, molecule_id ORDER BY position DESC, amount DESC) = 1""",
    rows_="""SELECT formulation_id, value FROM measurements WHERE property_type = 'extendedprice'
             AND (temperature IS NULL OR temperature = 0 OR temperature BETWEEN 15 AND 25)""",
    mol="SELECT DISTINCT molecule_id FROM components"))
def amount_correlations(spark, sf):
    out = M.amount_correlations(B.components(spark, sf), B.line_measurements(spark, sf), "extendedprice", min_correlation=0.0)
    return rounded(rounded(out, 6, "correlation"), 4, "mean_with")


RULES_SQL = """
    SELECT 'co-occurs-with' AS head_relation, a AS antecedent, b AS consequent, n AS support,
           round(n * 1.0 / ca.c, 6) AS confidence, round(n * 1.0 / cb.c, 6) AS head_coverage
    FROM (SELECT a, b, n FROM pairs UNION ALL SELECT b, a, n FROM pairs) p
    JOIN cnt ca ON ca.molecule_id = a JOIN cnt cb ON cb.molecule_id = b
    WHERE n >= 3 AND n * 1.0 / ca.c >= {conf}"""
RULES_CTES = dict(
    lines="SELECT formulation_id, molecule_id, row_number() OVER (PARTITION BY formulation_id ORDER BY position, amount, molecule_id) AS rn FROM components",
    pairs="""SELECT least(x.molecule_id, y.molecule_id) AS a, greatest(x.molecule_id, y.molecule_id) AS b, count(*) AS n
             FROM lines x JOIN lines y ON x.formulation_id = y.formulation_id AND x.rn < y.rn GROUP BY ALL""",
    cnt="SELECT molecule_id, count(*) AS c FROM components GROUP BY ALL")


@query("co_occurrence_rules", "W-78", with_("components", RULES_SQL.format(conf="0.05"), **RULES_CTES))
def co_occurrence_rules(spark, sf):
    return rounded(M.co_occurrence_rules(B.components(spark, sf), min_confidence=0.05), 6, "confidence", "head_coverage")


THRESHOLD_CTES = dict(
    mult=MULT,
    m="SELECT formulation_id, value FROM measurements WHERE property_type = 'extendedprice'",
    cut="SELECT quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM m",
    f="SELECT formulation_id, count(*) AS n, count(*) FILTER (value >= hi) AS high, count(*) FILTER (value <= lo) AS low FROM m, cut GROUP BY 1",
    size="SELECT sum(high) AS high, sum(low) AS low FROM f",
    c="SELECT molecule_id, sum(m * n) AS n, sum(m * high) AS high, sum(m * low) AS low FROM mult JOIN f USING (formulation_id) GROUP BY 1",
    long="SELECT molecule_id, n, 'high' AS class, high AS k, (SELECT high FROM size) AS s FROM c UNION ALL SELECT molecule_id, n, 'low', low, (SELECT low FROM size) FROM c")
THRESHOLD_SQL = """
    SELECT class || '_extendedprice' AS head_relation, molecule_id AS antecedent, CAST(k AS BIGINT) AS support,
           round(k / n, 6) AS confidence, round(k / s, 6) AS head_coverage
    FROM long WHERE k >= 3 AND k / n >= {conf}"""


@query("threshold_rules", "W-79", with_("components measurements", THRESHOLD_SQL.format(conf="0.2"), **THRESHOLD_CTES))
def threshold_rules(spark, sf):
    out = M.threshold_rules(B.components(spark, sf), B.line_measurements(spark, sf), "extendedprice", min_confidence=0.2)
    return rounded(out, 6, "confidence", "head_coverage")


LIFT_CTES = dict(
    sets="SELECT DISTINCT formulation_id, molecule_id FROM components",
    tot="SELECT count(DISTINCT formulation_id) AS n FROM sets",
    freq="SELECT molecule_id, count(*) AS f FROM sets GROUP BY 1",
    top="""SELECT x.molecule_id AS comp_1, y.molecule_id AS comp_2, count(*) AS pair_count
           FROM sets x JOIN sets y ON x.formulation_id = y.formulation_id AND x.molecule_id < y.molecule_id
           GROUP BY ALL""",
    lifted="""SELECT comp_1, comp_2, pair_count, a.f AS freq_1, b.f AS freq_2,
              (pair_count * 1.0 / n) / ((a.f * 1.0 / n) * (b.f * 1.0 / n)) AS lift, pair_count * 100.0 / n AS support_pct
              FROM top JOIN freq a ON a.molecule_id = comp_1 JOIN freq b ON b.molecule_id = comp_2, tot WHERE pair_count >= 5""")


LIFTED = """
    SELECT comp_1, comp_2, pair_count, freq_1, freq_2, round(lift, 6) AS lift, round(least(1.0, lift / 2), 6) AS confidence,
           round(support_pct, 6) AS support_pct
    FROM lifted WHERE least(1.0, lift / 2) >= 0.5"""


@query("association_lift", "W-80", with_("components", LIFTED, **LIFT_CTES))
def association_lift(spark, sf):
    out = M.association_lift(B.components(spark, sf), min_confidence=0.5)
    return rounded(out, 6, "lift", "confidence", "support_pct")


@query("association_lift_of_top_pairs", "W-80", with_("components", LIFTED, **LIFT_CTES | {
    "top": LIFT_CTES["top"] + " ORDER BY pair_count DESC, comp_1, comp_2 LIMIT 100"}))
def association_lift_of_top_pairs(spark, sf):
    out = M.association_lift(B.components(spark, sf), min_confidence=0.5, top_pairs=100)
    return rounded(out, 6, "lift", "confidence", "support_pct")


CORR_CTES = dict(
    em="SELECT entity_id, property_type, avg(value) AS v FROM entity_measurements GROUP BY ALL",
    pr="""SELECT a.property_type AS property_1, b.property_type AS property_2, count(*) AS n, corr(a.v, b.v) AS r
          FROM em a JOIN em b ON a.entity_id = b.entity_id AND a.property_type < b.property_type GROUP BY ALL HAVING count(*) >= 10""",
    tt="SELECT *, r * sqrt((n - 2) / greatest(1 - r * r, 1e-300)) AS t FROM pr",
    correlated=f"SELECT property_1, property_2, n, r, t, {t_tail('t', '(n - 2)')} AS p FROM tt")


@query("property_correlations", "W-81 W-104", with_("entity_measurements", """
    SELECT property_1, property_2, n, round(r, 6) AS r, round(t, 4) AS t, round(p, 6) AS p_value FROM correlated""", **CORR_CTES))
def property_correlations(spark, sf):
    out = ST.property_correlations(B.entity_measurements(spark, sf))
    return rounded(rounded(out, 6, "r", "p_value"), 4, "t")


CAUSAL_CTES = dict(
    sets="SELECT DISTINCT formulation_id, molecule_id FROM components",
    forms="SELECT DISTINCT formulation_id FROM sets",
    m="SELECT * FROM measurements WHERE formulation_id IN (SELECT formulation_id FROM forms)",
    ids="SELECT DISTINCT molecule_id, property_type FROM (SELECT DISTINCT molecule_id FROM sets), (SELECT DISTINCT property_type FROM m)",
    flagged="""SELECT ids.molecule_id, property_type, value, s.molecule_id IS NOT NULL AS has FROM ids JOIN m USING (property_type)
               LEFT JOIN sets s ON s.formulation_id = m.formulation_id AND s.molecule_id = ids.molecule_id""",
    g="""SELECT molecule_id, property_type, count(*) FILTER (has) AS n1, count(*) FILTER (NOT has) AS n2,
         avg(value) FILTER (has) AS m1, avg(value) FILTER (NOT has) AS m2, var_pop(value) FILTER (has) AS v1, var_pop(value) FILTER (NOT has) AS v2
         FROM flagged GROUP BY ALL""",
    h="""SELECT *, CASE WHEN v2 > 0 THEN (m1 - m2) / sqrt(v2) ELSE 0 END AS effect,
         (m1 - m2) / sqrt((n1 * v1 + n2 * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM g WHERE n1 >= 5 AND n2 >= 5""",
    contrast=f"SELECT *, {t_tail('t', '(n1 + n2 - 2)')} AS p FROM h")


@query("causal_contrasts", "W-82 W-104", with_("components measurements", """
    SELECT molecule_id, property_type, n1 AS n_with, n2 AS n_without, round(m1, 4) AS with_mean, round(m2, 4) AS without_mean,
           round(effect, 6) AS effect_size, round(t, 4) AS t_statistic, round(p, 6) AS p_value FROM contrast""", **CAUSAL_CTES))
def causal_contrasts(spark, sf):
    out = M.causal_contrasts(B.components(spark, sf), B.measurements(spark, sf))
    return rounded(rounded(out, 6, "effect_size", "p_value"), 4, "with_mean", "without_mean", "t_statistic")


@query("iqr_outliers", "W-83", with_("entity_measurements", """
    SELECT id, property_type, round(value, 4) AS value, round(lower, 4) AS lower, round(upper, 4) AS upper, n, n_outliers FROM (
      SELECT *, count(*) OVER (PARTITION BY property_type) AS n_outliers FROM entity_measurements JOIN b USING (property_type)
      WHERE value < lower OR value > upper) WHERE n_outliers < n * 0.05""",
    q="SELECT property_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM entity_measurements GROUP BY 1",
    b="SELECT property_type, n, q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper FROM q WHERE n >= 10"))
def iqr_outliers(spark, sf):
    out = ST.iqr_outliers(B.entity_measurements(spark, sf))
    out = out.select("id", "property_type", "value", "lower", "upper", "n", "n_outliers")
    return rounded(out, 4, "value", "lower", "upper")


@query("mined_families", "W-88", with_("components measurements", f"""
    SELECT 'patterns' AS family, count(*) AS n FROM pe
    UNION ALL SELECT 'amount_patterns', count(*) FROM ac
    UNION ALL SELECT 'co_occurrence_rules', count(*) FROM ({RULES_SQL.format(conf="0.05")})
    UNION ALL SELECT 'threshold_rules', count(*) FROM ({THRESHOLD_SQL.format(conf="0.05")})""",
    **RULES_CTES, **THRESHOLD_CTES,
    tot="SELECT count(*) AS n, sum(value) AS s, stddev_pop(value) AS sd FROM m",
    fs="SELECT formulation_id, count(*) AS fn, sum(value) AS fs FROM m GROUP BY 1",
    pe="""SELECT molecule_id FROM mult JOIN fs USING (formulation_id), tot GROUP BY molecule_id
          HAVING sum(m * fn) >= 3 AND any_value(n) - sum(fn) >= 3 AND
          abs((sum(m * fs) / sum(m * fn) - (any_value(s) - sum(fs)) / (any_value(n) - sum(fn))) / (any_value(sd) + 1e-8)) >= 0.01""",
    amounts="""SELECT formulation_id, molecule_id, amount AS a FROM components
               QUALIFY row_number() OVER (PARTITION BY formulation_id, molecule_id ORDER BY position DESC, amount DESC) = 1""",
    rows_="""SELECT formulation_id, value FROM measurements WHERE property_type = 'extendedprice'
             AND (temperature IS NULL OR temperature = 0 OR temperature BETWEEN 15 AND 25)""",
    mol="SELECT DISTINCT molecule_id FROM components",
    ac="""SELECT molecule_id FROM mol CROSS JOIN rows_ LEFT JOIN amounts USING (formulation_id, molecule_id) GROUP BY molecule_id
          HAVING count(*) >= 10 AND stddev_pop(coalesce(a, 0)) >= 1e-6 AND abs(corr(coalesce(a, 0), value)) >= 0.01"""))
def mined_families(spark, sf):
    return M.mined_families(B.components(spark, sf), B.line_measurements(spark, sf), "extendedprice",
                            min_support=3, min_confidence=0.05, min_correlation=0.01)


@query("cross_property_correlations", "W-51 W-157", with_("entity_measurements", """
    SELECT property_type, round(corr(v, c), 6) AS correlation, count(*) AS n_components,
           CASE WHEN abs(corr(v, c)) > 0.5 THEN 'strong' WHEN abs(corr(v, c)) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength
    FROM em JOIN spend USING (entity_id) WHERE property_type <> 'purchase' GROUP BY property_type""",
    em="SELECT entity_id, property_type, avg(value) AS v FROM entity_measurements GROUP BY ALL",
    spend="SELECT entity_id, v AS c FROM em WHERE property_type = 'purchase'"))
def cross_property_correlations(spark, sf):
    means = ST.entity_property_means(B.entity_measurements(spark, sf))
    props = means.where("property_type <> 'purchase'").select(
        F.col("entity_id").alias("component"), "property_type", F.col("mean_value").alias("property_value"))
    target = means.where("property_type = 'purchase'").select(F.col("entity_id").alias("component"), F.col("mean_value").alias("mean"))
    return rounded(ST.cross_property_correlations(props, target), 6, "correlation")


PIVOT = dict(
    firsts="""SELECT entity_id, property_type, arg_min(value, id) AS v FROM entity_measurements GROUP BY ALL""",
    wide="""SELECT entity_id, max(v) FILTER (property_type = 'view') AS view, max(v) FILTER (property_type = 'click') AS click,
            max(v) FILTER (property_type = 'purchase') AS purchase FROM firsts GROUP BY 1""")


def _comparison(spark, sf):
    props = B.entity_measurements(spark, sf).select(
        F.col("entity_id").alias("component"), "property_type", F.col("value").alias("property_value"), F.col("id").alias("row_order"))
    return ST.comparison_pivot(props, ["view", "click", "purchase"])


@query("comparison_pivot", "W-90", with_("entity_measurements", """
    SELECT entity_id AS component, view, click, purchase FROM wide""", **PIVOT))
def comparison_pivot(spark, sf):
    return _comparison(spark, sf)


@query("comparison_melted", "W-90", with_("entity_measurements", """
    SELECT entity_id AS component, 'view' AS level, view AS energy FROM wide WHERE view IS NOT NULL
    UNION ALL SELECT entity_id, 'click', click FROM wide WHERE click IS NOT NULL""", **PIVOT))
def comparison_melted(spark, sf):
    return ST.melt(_comparison(spark, sf), ["component"], ["view", "click"], "level", "energy").where("energy IS NOT NULL")


@query("gap_and_scaled_profile", "W-89", with_("entity_measurements", """
    SELECT entity_id AS component, round(click - view, 4) AS gap,
           round(coalesce((view - min(view) OVER ()) / (max(view) OVER () - min(view) OVER ()), 0), 6) AS view,
           round(coalesce((click - min(click) OVER ()) / (max(click) OVER () - min(click) OVER ()), 0), 6) AS click,
           round(coalesce((purchase - min(purchase) OVER ()) / (max(purchase) OVER () - min(purchase) OVER ()), 0), 6) AS purchase
    FROM wide""", **PIVOT))
def gap_and_scaled_profile(spark, sf):
    wide = ST.energy_gap(_comparison(spark, sf), "view", "click")
    return rounded(rounded(ST.min_max_scaled(wide, ["view", "click", "purchase"]), 6, "view", "click", "purchase"), 4, "gap")


@query("log_scaled_sizes", "W-91", """
    WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT *, log10(n + 1) AS lv FROM c)
    SELECT source, n, round(lv, 6) AS log_value,
           round(CASE WHEN max(lv) OVER () > min(lv) OVER () THEN 0.4 + 0.8 * (lv - min(lv) OVER ()) / (max(lv) OVER () - min(lv) OVER ()) ELSE 0.8 END, 6) AS size FROM l""")
def log_scaled_sizes(spark, sf):
    counts = B.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rounded(ST.log_scaled_sizes(counts, "n"), 6, "log_value", "size")
