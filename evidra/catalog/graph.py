"""Graph-shaped lookups, searches and gap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra import bindings as B
from evidra.catalog import query
from evidra.catalog.sqlparts import with_
from evidra.operators import gaps as G, relational as R


@query("triples_export", "W-18", with_("relations", "SELECT subject, predicate, object, count(*) AS copies FROM relations GROUP BY ALL"))
def triples_export(spark, sf):
    return B.relations(spark, sf).select(*R.SPO).groupBy(*R.SPO).agg(F.count("*").alias("copies"))


@query("edge_pattern_bag", "W-19", with_("relations", """
    SELECT subject, predicate, object FROM relations WHERE predicate = 'hasSolvent' AND object = 'Brand#3'"""))
def edge_pattern_bag(spark, sf):
    return R.edge_match(B.relations(spark, sf), predicate="hasSolvent", object="Brand#3")


@query("triple_pattern_set", "W-20", with_("relations", """
    SELECT DISTINCT subject, predicate, object FROM relations WHERE object = 'Brand#3'"""))
def triple_pattern_set(spark, sf):
    return R.edge_match(R.triples(B.relations(spark, sf)), object="Brand#3")


@query("triple_vocabulary", "W-21", with_("relations", """
    SELECT 'subject' AS position, count(DISTINCT subject) AS n FROM relations
    UNION ALL SELECT 'predicate', count(DISTINCT predicate) FROM relations
    UNION ALL SELECT 'object', count(DISTINCT object) FROM relations
    UNION ALL SELECT 'triple', count(*) FROM (SELECT DISTINCT subject, predicate, object FROM relations)"""))
def triple_vocabulary(spark, sf):
    return R.vocabulary_sizes(R.triples(B.relations(spark, sf)))


@query("triple_add_remove", "W-22", with_("relations", """
    SELECT predicate, count(*) AS n FROM (
      (SELECT subject, predicate, object FROM relations UNION SELECT object, 'partOf', subject FROM relations WHERE predicate = 'hasSolvent')
      EXCEPT SELECT subject, predicate, object FROM relations WHERE predicate = 'hasSalt') GROUP BY 1"""))
def triple_add_remove(spark, sf):
    edges = B.relations(spark, sf)
    new = R.edge_match(edges, predicate="hasSolvent").select(
        F.col("object").alias("subject"), F.lit("partOf").alias("predicate"), F.col("subject").alias("object"))
    gone = R.edge_match(edges, predicate="hasSalt")
    return R.remove_triples(R.add_triples(edges, new), gone).groupBy("predicate").agg(F.count("*").alias("n"))


@query("hypotheses_by_status_novelty", "W-23", with_("hypotheses", """
    SELECT id, subject, predicate, object, confidence FROM hypotheses WHERE status = 'validated' AND is_novel"""))
def hypotheses_by_status_novelty(spark, sf):
    return B.hypotheses(spark, sf).where("status = 'validated' AND is_novel").select("id", *R.SPO, "confidence")


@query("hypotheses_by_type_confidence", "W-35", with_("hypotheses", """
    SELECT id, predicate, confidence FROM hypotheses WHERE predicate IN ('increases', 'coOccursWith') AND confidence >= 0.5"""))
def hypotheses_by_type_confidence(spark, sf):
    return B.hypotheses(spark, sf).where(
        F.col("predicate").isin("increases", "coOccursWith") & (F.col("confidence") >= 0.5)).select("id", "predicate", "confidence")


@query("entity_lookup", "W-24", """
    SELECT id, arg_min(entity_type, r) AS entity_type, arg_min(name, r) AS name FROM (
      SELECT CAST(p_partkey AS VARCHAR) AS id, 'Molecule' AS entity_type, p_name AS name, 0 AS r FROM part
      UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'ElectrolyteFormulation', c_name, 1 FROM customer
      UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'EvidenceSource', s_name, 2 FROM supplier) GROUP BY id""")
def entity_lookup(spark, sf):
    pick = lambda t, i, n: B.table(spark, sf, t).select(F.col(i).alias("id"), F.col(n).alias("name"))
    return R.entity_lookup([
        ("Molecule", pick("part", "p_partkey", "p_name")),
        ("ElectrolyteFormulation", pick("customer", "c_custkey", "c_name")),
        ("EvidenceSource", pick("supplier", "s_suppkey", "s_name"))])


def _orders(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))


@query("formulations_with_component", "W-25", with_("components", """
    SELECT o_orderkey AS id, o_orderpriority AS name FROM orders
    WHERE o_orderkey IN (SELECT formulation_id FROM components WHERE molecule_id = 'Brand#7')"""))
def formulations_with_component(spark, sf):
    return R.formulations_with_component(_orders(spark, sf), B.components(spark, sf), "Brand#7")


@query("formulations_by_property", "W-26", with_("line_measurements", """
    SELECT m.id, formulation_id, o_orderpriority AS name, value FROM line_measurements m JOIN orders ON o_orderkey = formulation_id
    WHERE property_type = 'extendedprice' AND value >= 20000 AND value <= 60000 AND temperature = 25"""))
def formulations_by_property(spark, sf):
    return R.formulations_by_property(
        _orders(spark, sf), B.line_measurements(spark, sf), "extendedprice", min_value=20000, max_value=60000, temperature=25
    ).select("id", "formulation_id", "name", "value")


@query("measurements_in_range", "W-156", with_("entity_measurements", """
    SELECT id, entity_id, value FROM entity_measurements WHERE property_type = 'purchase' AND value >= 100"""))
def measurements_in_range(spark, sf):
    return R.measurements_in_range(B.entity_measurements(spark, sf), "purchase", min_value=100).select("id", "entity_id", "value")


@query("components_of_type", "W-36", with_("components", """
    SELECT formulation_id, molecule_id, amount FROM components WHERE component_type = 'additive'"""))
def components_of_type(spark, sf):
    return R.components_of_type(B.components(spark, sf), "additive").select("formulation_id", "molecule_id", "amount")


def _unified(spark, sf):
    parts = B.parts(spark, sf)
    suppliers = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.lit("").alias("smiles"), F.array().cast("array<string>").alias("synonyms"))
    parts = parts.withColumn("id", F.concat(F.lit("part:"), "id"))
    cols = ["id", "name", "smiles", "synonyms"]
    return R.unified_entities([
        ("molecules", parts.where("role = 'additive'").select(*cols)),
        ("solvent", parts.where("role = 'solvent'").select(*cols)),
        ("salt", parts.where("role = 'salt'").select(*cols)),
        ("interphase", suppliers)])


UNIFIED = """
    SELECT 'part:' || id AS id, name, smiles, CASE role WHEN 'additive' THEN 'molecule' ELSE role END AS type,
           CASE role WHEN 'additive' THEN 'molecules' ELSE role END AS store, synonyms FROM parts
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, '', 'interphase', 'interphase', CAST([] AS VARCHAR[]) FROM supplier"""


@query("unified_entities", "W-28", with_("parts", "SELECT id, name, smiles, type, store, array_to_string(synonyms, '|') AS synonyms FROM u", u=UNIFIED))
def unified_entities(spark, sf):
    return _unified(spark, sf).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("entity_search", "W-27", with_("parts", """
    SELECT id, name, type FROM u WHERE type IN ('solvent', 'salt') AND
      (contains(lower(name), 'brand#1') OR contains(lower(smiles), 'brand#1') OR contains(lower(type), 'brand#1')
       OR len(list_filter(synonyms, lambda s: contains(lower(s), 'brand#1'))) > 0)
    ORDER BY name, id LIMIT 50""", u=UNIFIED))
def entity_search(spark, sf):
    return R.search_entities(_unified(spark, sf), "BRAND#1", ["solvent", "salt"], 50).select("id", "name", "type")


@query("entity_label_search", "W-134", with_("parts", """
    SELECT id, name || ' (' || type || ')' AS label FROM u WHERE contains(lower(name || ' (' || type || ')'), 'bolt') ORDER BY label, id LIMIT 20""", u=UNIFIED))
def entity_label_search(spark, sf):
    return R.search_by_label(_unified(spark, sf), "Bolt", 20).select("id", "label")


def _link_entities(spark, sf):
    parts = B.table(spark, sf, "part").select(
        F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat(F.lit("P#"), "p_partkey").alias("name"),
        B.component_type(F.col("p_type")).alias("type"), F.array(F.concat(F.lit("syn-"), "p_partkey")).alias("synonyms"))
    suppliers = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.lit("interphase").alias("type"), F.array().cast("array<string>").alias("synonyms"))
    return parts.unionByName(suppliers)


def _links(spark, sf):
    """Order lines as part-supplier edges; odd line numbers write the part by name."""
    flag = F.col("l_returnflag")
    by_name = F.col("l_linenumber") % 2 == 1
    return B.table(spark, sf, "lineitem").select(
        F.concat(F.when(by_name, "P#").otherwise("part:"), "l_partkey").alias("subject"),
        F.when(flag == "R", "sameAs").when(flag == "A", "coOccursWith").otherwise("hasMeasurement").alias("predicate"),
        F.concat(F.lit("supplier:"), "l_suppkey").alias("object"))


LINKS = dict(
    ent="""SELECT 'part:' || p_partkey AS id, 'P#' || p_partkey AS name, CASE WHEN p_type IN ('STANDARD','MEDIUM') THEN 'solvent'
             WHEN p_type IN ('ECONOMY','SMALL') THEN 'salt' ELSE 'additive' END AS type, 'syn-' || p_partkey AS syn FROM part
           UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'interphase', NULL FROM supplier""",
    links="""SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'P#' ELSE 'part:' END || l_partkey AS subject,
             CASE l_returnflag WHEN 'R' THEN 'sameAs' WHEN 'A' THEN 'coOccursWith' ELSE 'hasMeasurement' END AS predicate,
             'supplier:' || l_suppkey AS object FROM lineitem""",
    seeds="SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_nationkey = 7",
    inc="""SELECT predicate, 'outgoing' AS direction, subject AS id, object AS other_id FROM links WHERE predicate <> 'hasMeasurement'
           UNION ALL SELECT predicate, 'incoming', object, subject FROM links WHERE predicate <> 'hasMeasurement' AND subject <> object""",
    seen="SELECT inc.*, e.name AS other_name, e.type AS other_type FROM inc JOIN ent e ON e.id = other_id WHERE inc.id IN (SELECT id FROM seeds)")


def _seeds(spark, sf):
    return B.table(spark, sf, "supplier").where("s_nationkey = 7").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))


@query("incident_edges", "W-29", with_("", """
    SELECT id, direction, predicate, other_id, other_name, other_type, count(*) AS copies FROM seen GROUP BY ALL""", **LINKS))
def incident_edges(spark, sf):
    out = R.incident_edges(_links(spark, sf), _link_entities(spark, sf), _seeds(spark, sf))
    return out.groupBy("id", "direction", "predicate", "other_id", "other_name", "other_type").agg(F.count("*").alias("copies"))


@query("incident_sample", "W-33", with_("", """
    SELECT id, direction, predicate, other_id, other_name, rn FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY direction DESC, predicate, other_id) AS rn FROM seen) WHERE rn <= 10""", **LINKS))
def incident_sample(spark, sf):
    inc = R.incident_edges(_links(spark, sf), _link_entities(spark, sf), _seeds(spark, sf))
    return R.incident_sample(inc, 10).select("id", "direction", "predicate", "other_id", "other_name", F.col("rn").cast("bigint").alias("rn"))


@query("neighbours", "W-31", with_("", """
    SELECT DISTINCT other_id AS id, other_name AS name, other_type AS type FROM seen WHERE other_id NOT IN (SELECT id FROM seeds) ORDER BY 1 LIMIT 50""", **LINKS))
def neighbours(spark, sf):
    return R.neighbours(_links(spark, sf), _link_entities(spark, sf), _seeds(spark, sf), 50)


@query("induced_subgraph", "W-30", with_("", """
    SELECT s.id AS source, predicate, o.id AS target, count(*) AS copies FROM links
    JOIN ent s ON (subject = s.id OR subject = s.name OR subject = s.syn) AND s.type IN ('solvent', 'interphase')
    JOIN ent o ON (object = o.id OR object = o.name) AND o.type IN ('solvent', 'interphase') GROUP BY ALL""", **LINKS))
def induced_subgraph(spark, sf):
    ent = _link_entities(spark, sf)
    nodes = ent.where(F.col("type").isin("solvent", "interphase"))
    out = R.induced_subgraph(_links(spark, sf), ent, nodes)
    return out.groupBy("source", "predicate", "target").agg(F.count("*").alias("copies"))


@query("entity_measurement_list", "W-32", with_("relations order_measurements", """
    SELECT subject AS entity_id, m.id, property_type, value FROM relations JOIN order_measurements m ON m.id = object WHERE predicate = 'hasMeasurement'"""))
def entity_measurement_list(spark, sf):
    return R.measurements_of_entities(B.relations(spark, sf), B.order_measurements(spark, sf)).select("entity_id", "id", "property_type", "value")


@query("relation_report", "W-34", with_("relations", """
    SELECT subject, predicate, object, coalesce(s_name, substr(subject, 1, 12) || '...') AS subject_name, coalesce(n_name, substr(object, 1, 12) || '...') AS object_name,
           (SELECT count(*) FROM relations WHERE predicate = 'inNation') AS total, least((SELECT count(*) FROM relations WHERE predicate = 'inNation'), 100) AS listed
    FROM (SELECT * FROM relations WHERE predicate = 'inNation' ORDER BY subject, object LIMIT 5)
    LEFT JOIN supplier ON subject = 'supplier:' || s_suppkey LEFT JOIN nation ON object = 'nation:' || n_nationkey"""))
def relation_report(spark, sf):
    names = B.table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(
        B.table(spark, sf, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return R.relation_report(B.relations(spark, sf), names, "inNation")


@query("constraint_violations", "W-37", with_("components relations", """
    SELECT predicate, bad_subject, bad_object, count(*) AS n FROM (
      SELECT r.predicate, NOT starts_with(subject, 'order:') AS bad_subject,
             CASE r.predicate WHEN 'hasMeasurement' THEN NOT starts_with(object, 'm:')
                  WHEN 'hasSolvent' THEN coalesce(k, '') <> 'Solvent' WHEN 'hasSalt' THEN coalesce(k, '') <> 'Salt' ELSE true END AS bad_object
      FROM relations r LEFT JOIN kinds ON object = brand WHERE r.predicate IN ('hasSolvent','hasSalt','hasAdditive','hasMeasurement'))
    WHERE bad_subject OR bad_object GROUP BY ALL""",
    kinds="SELECT DISTINCT p_brand AS brand, CASE WHEN p_brand IN ('Brand#1','Brand#3','Brand#5') THEN 'Solvent' ELSE 'Salt' END AS k FROM part"))
def constraint_violations(spark, sf):
    orders = B.table(spark, sf, "orders")
    kinds = B.table(spark, sf, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("id"), F.when(F.col("p_brand").isin("Brand#1", "Brand#3", "Brand#5"), "Solvent").otherwise("Salt").alias("type"))
    types = kinds.unionByName(orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.lit("ElectrolyteFormulation").alias("type"))
        ).unionByName(orders.select(F.concat(F.lit("m:"), "o_orderkey").alias("id"), F.lit("PropertyMeasurement").alias("type")))
    out = R.constraint_violations(B.relations(spark, sf), types)
    return out.groupBy("predicate", "bad_subject", "bad_object").agg(F.count("*").alias("n"))


@query("component_edges", "W-42", with_("components", """
    SELECT formulation_id AS subject, CASE component_type WHEN 'solvent' THEN 'hasSolvent' WHEN 'salt' THEN 'hasSalt' ELSE 'hasAdditive' END AS predicate,
           molecule_id AS object FROM components WHERE molecule_id IN (SELECT p_brand FROM part WHERE length(p_brand) % 2 = 0)"""))
def component_edges(spark, sf):
    known = B.table(spark, sf, "part").where("length(p_brand) % 2 = 0").select(F.col("p_brand").alias("id"))
    return R.component_edges(B.components(spark, sf), known)


@query("hypotheses_not_in_graph", "W-47 W-161", with_("hypotheses", """
    SELECT id, subject, predicate, object FROM hypotheses h WHERE NOT EXISTS (
      SELECT 1 FROM known k WHERE k.subject = h.subject AND k.predicate = h.predicate AND k.object = h.object)""",
    known="SELECT DISTINCT subject, 'increases' AS predicate, object FROM hypotheses WHERE predicate <> 'increases'"))
def hypotheses_not_in_graph(spark, sf):
    h = B.hypotheses(spark, sf)
    known = h.where("predicate <> 'increases'").select("subject", F.lit("increases").alias("predicate"), "object")
    return R.without_existing(h, known).select("id", *R.SPO)


def _gap_inputs(spark, sf):
    return B.customers(spark, sf), B.entity_measurements(spark, sf)


@query("entities_without_measurements", "W-44", with_("customers entity_measurements", """
    SELECT id, role FROM customers WHERE id NOT IN (SELECT entity_id FROM entity_measurements)"""))
def entities_without_measurements(spark, sf):
    customers, meas = _gap_inputs(spark, sf)
    return G.without_measurements(customers.select("id", "role"), meas)


COVERAGE = """
    SELECT 'missing_measurements' AS gap_type, kind AS detail, count(*) AS entity_count,
           CAST(CASE kind WHEN 'solvent' THEN 0.8 WHEN 'salt' THEN 0.7 WHEN 'other' THEN 0.5 ELSE 0.9 END AS DOUBLE) AS priority, true AS actionable,
           count(*) || ' ' || CASE kind WHEN 'other' THEN 'molecules' ELSE kind || 's' END
             || CASE kind WHEN 'formulation' THEN ' have no measurements' ELSE ' have no property measurements' END AS description
    FROM (SELECT 'c' || id AS id, CASE WHEN role IN ('solvent','salt') THEN role ELSE 'other' END AS kind FROM customers WHERE id NOT IN (SELECT entity_id FROM entity_measurements)
          UNION ALL SELECT 'o' || o_orderkey, 'formulation' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) GROUP BY kind"""


def _coverage_missing(spark, sf):
    customers, meas = _gap_inputs(spark, sf)
    kind = F.when(F.col("role").isin("solvent", "salt"), F.col("role")).otherwise("other")
    entities = customers.select(F.concat(F.lit("c"), "id").alias("id"), kind.alias("kind")).unionByName(
        B.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("formulation").alias("kind")))
    measured = meas.select(F.concat(F.lit("c"), "entity_id").alias("entity_id")).unionByName(
        B.table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("entity_id")))
    return G.without_measurements(entities, measured)


@query("coverage_gaps", "W-84", with_("customers entity_measurements", COVERAGE))
def coverage_gaps(spark, sf):
    return G.coverage_gaps(_coverage_missing(spark, sf))


SAME_AS = "SELECT l_partkey AS subject, l_suppkey AS object FROM lineitem WHERE l_returnflag = 'R'"


@query("missing_links", "W-45", with_("parts", """
    SELECT smiles, members, members * (members - 1) // 2 AS pairs, coalesce(l, 0) AS linked, members * (members - 1) // 2 - coalesce(l, 0) AS missing
    FROM (SELECT smiles, count(*) AS members FROM parts GROUP BY 1 HAVING count(*) > 1) LEFT JOIN (
      SELECT x.smiles, count(*) AS l FROM (SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM same WHERE subject <> object)
      JOIN parts x ON x.id = a JOIN parts y ON y.id = b WHERE x.smiles = y.smiles GROUP BY 1) USING (smiles)""", same=SAME_AS))
def missing_links(spark, sf):
    edges = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("subject"), F.lit("sameAs").alias("predicate"), F.col("l_suppkey").alias("object"))
    return G.missing_link_counts(B.parts(spark, sf), edges)


PARTIAL = dict(
    has="SELECT DISTINCT entity_id, property_type FROM entity_measurements",
    lacking="""SELECT id, p AS missing_property FROM customers, (VALUES ('click'), ('purchase'), ('refund')) v(p)
               WHERE role = 'solvent' AND id IN (SELECT entity_id FROM has) AND NOT EXISTS (SELECT 1 FROM has WHERE entity_id = id AND property_type = p)""")


@query("missing_properties", "W-46", with_("customers entity_measurements", "SELECT id, missing_property FROM lacking", **PARTIAL))
def missing_properties(spark, sf):
    customers, meas = _gap_inputs(spark, sf)
    return G.missing_properties(customers.where("role = 'solvent'").select("id"), meas, ["click", "purchase", "refund"])


GAPS = f"""
    {COVERAGE}
    UNION ALL SELECT 'missing_sameAs_link', 'molecule pairs', n, 0.85::DOUBLE, true, n || ' molecule pairs share SMILES but lack sameAs links'
      FROM (SELECT sum(k * (k - 1) // 2)::BIGINT AS n FROM (SELECT count(*) AS k FROM customers GROUP BY role HAVING count(*) > 1))
    UNION ALL SELECT 'partial_property_coverage', missing_property, count(*), 0.7::DOUBLE, true, count(*) || ' solvents missing ' || missing_property || ' measurements' FROM lacking GROUP BY 2
    UNION ALL SELECT 'potential_outlier', property_type, k, 0.6::DOUBLE, false, k || ' potential outliers in ' || property_type FROM (
      SELECT property_type, any_value(n) AS n, count(*) AS k FROM entity_measurements JOIN bounds USING (property_type) WHERE value < lo OR value > hi GROUP BY 1)
      WHERE k < n * 0.05"""
GAP_CTES = dict(
    **PARTIAL,
    bounds="""SELECT property_type, count(*) AS n, quantile_cont(value, 0.25) - 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
              quantile_cont(value, 0.75) + 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM entity_measurements GROUP BY 1""",
    gaps=GAPS)


def explored(spark, sf):
    customers, meas = _gap_inputs(spark, sf)
    molecules = customers.select(F.concat(F.lit("c"), "id").alias("id"), "role", F.col("role").alias("smiles"))
    formulations = B.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    typed = meas.select("id", F.concat(F.lit("c"), "entity_id").alias("entity_id"), "property_type", "value")
    lines = B.table(spark, sf, "lineitem").select(
        F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("entity_id"),
        F.lit(None).cast("string").alias("property_type"), F.lit(None).cast("double").alias("value"))
    no_edges = B.relations(spark, sf)
    return G.explore(molecules, formulations, typed.unionByName(lines), no_edges, ["click", "purchase", "refund"])


@query("gaps_found", "W-84 W-119", with_("customers entity_measurements", "SELECT * FROM gaps", **GAP_CTES))
def gaps_found(spark, sf):
    return explored(spark, sf)


@query("gap_summary", "W-68", with_("customers entity_measurements", """
    SELECT gap_type, count(*) AS gaps, count(*) FILTER (actionable) AS actionable, CAST(sum(entity_count) AS BIGINT) AS entities FROM gaps GROUP BY 1""", **GAP_CTES))
def gap_summary(spark, sf):
    return G.gap_summary(explored(spark, sf))


@query("candidate_tasks", "W-87", with_("customers entity_measurements", """
    SELECT CASE gap_type WHEN 'missing_measurements' THEN 'predict_property' WHEN 'missing_sameAs_link' THEN 'link_entities' ELSE 'complete_properties' END AS task,
           CASE gap_type WHEN 'missing_measurements' THEN 'Predict properties for ' || CASE detail WHEN 'formulation' THEN 'entity' ELSE detail END
                WHEN 'missing_sameAs_link' THEN 'Create sameAs links for matching SMILES' ELSE 'Predict ' || detail || ' for solvents' END AS description,
           priority, gap_type AS source_gap, detail FROM gaps WHERE actionable ORDER BY priority DESC, source_gap, detail LIMIT 10""", **GAP_CTES))
def candidate_tasks(spark, sf):
    return G.candidate_tasks(explored(spark, sf), 10)


@query("task_targets", "W-87", with_("customers entity_measurements", """
    SELECT gap, id FROM (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY id) AS rn FROM (
      SELECT 'c' || id AS id, CASE WHEN role IN ('solvent','salt') THEN role ELSE 'other' END AS gap FROM customers WHERE id NOT IN (SELECT entity_id FROM entity_measurements)
      UNION ALL SELECT 'o' || o_orderkey, 'formulation' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))) WHERE rn <= 100"""))
def task_targets(spark, sf):
    return G.task_targets(_coverage_missing(spark, sf).withColumnRenamed("kind", "gap"), 100).select("gap", "id")
