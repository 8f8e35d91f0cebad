"""Identity resolution, merging and scalar-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra import bindings as B, vocab
from evidra.catalog import query
from evidra.catalog.common import rounded
from evidra.catalog.sqlparts import with_
from evidra.functions import scalar as S
from evidra.operators import enrichment as E, identity as I, relational as R

IDENT = dict(
    k="SELECT *, trim(smiles) AS key, contains(name, '#') OR contains(name, '-') OR contains(name, '/') AS sl FROM parts",
    ranked="SELECT *, row_number() OVER (PARTITION BY key ORDER BY sl, length(name) DESC, id) AS rn, count(*) OVER (PARTITION BY key) AS n FROM k",
    best="SELECT key, id AS new_id, name AS new_name FROM ranked WHERE rn = 1",
    mapping="SELECT id AS old_id, new_id, key FROM ranked JOIN best USING (key) WHERE n > 1 AND id <> new_id",
    edges="SELECT l_partkey AS subject, CASE WHEN l_returnflag = 'R' THEN 'sameAs' ELSE 'coOccursWith' END AS predicate, l_suppkey AS object FROM lineitem",
    rew="""SELECT coalesce(a.new_id, subject) AS subject, predicate, coalesce(b.new_id, object) AS object, a.new_id IS NOT NULL OR b.new_id IS NOT NULL AS rewritten
           FROM edges LEFT JOIN mapping a ON a.old_id = subject LEFT JOIN mapping b ON b.old_id = object""")


def _edges(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("subject"),
        F.when(F.col("l_returnflag") == "R", "sameAs").otherwise("coOccursWith").alias("predicate"),
        F.col("l_suppkey").alias("object"))


@query("duplicate_map", "W-120 W-136 W-137", with_("parts", "SELECT old_id, new_id, key FROM mapping", **IDENT))
def duplicate_map(spark, sf):
    return I.duplicate_map(B.parts(spark, sf))


@query("dedup_stats", "W-120", with_("parts", """
    SELECT 'molecules_before' AS metric, (SELECT count(*) FROM parts) AS value
    UNION ALL SELECT 'duplicates_found', count(*) FROM mapping UNION ALL SELECT 'molecules_merged', count(*) FROM mapping
    UNION ALL SELECT 'relations_updated', count(*) FROM rew WHERE rewritten
    UNION ALL SELECT 'molecules_after', (SELECT count(*) FROM parts) - (SELECT count(*) FROM mapping)""", **IDENT))
def dedup_stats(spark, sf):
    return I.dedup_stats(B.parts(spark, sf), _edges(spark, sf))


@query("dedup_edges", "W-121", with_("parts", """
    SELECT DISTINCT subject, predicate, object FROM rew WHERE NOT (predicate = 'sameAs' AND subject = object)""", **IDENT))
def dedup_edges(spark, sf):
    return I.compact_edges(I.rewrite_edges(_edges(spark, sf), I.duplicate_map(B.parts(spark, sf))))


@query("dedup_components", "W-120", with_("parts", """
    SELECT coalesce(new_id, l_partkey) AS molecule_id, count(*) AS n, sum(l_quantity) AS amount FROM lineitem LEFT JOIN mapping ON old_id = l_partkey GROUP BY 1""", **IDENT))
def dedup_components(spark, sf):
    comps = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("formulation_id"), F.col("l_partkey").alias("molecule_id"), F.col("l_quantity").alias("amount"))
    out = I.rewrite_components(comps, I.duplicate_map(B.parts(spark, sf)))
    return out.groupBy("molecule_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("merged_molecules", "W-122 W-123", with_("parts", """
    SELECT arg_min(id, rn) AS id, arg_min(name, rn) AS name, key AS smiles, arg_min(inchi, rn) FILTER (inchi IS NOT NULL) AS inchi,
           arg_min(inchi_key, rn) FILTER (inchi_key IS NOT NULL) AS inchi_key, arg_min(pubchem_cid, rn) FILTER (pubchem_cid IS NOT NULL) AS pubchem_cid,
           arg_min(cas_number, rn) FILTER (cas_number IS NOT NULL) AS cas_number,
           arg_min(molecular_weight, rn) FILTER (molecular_weight IS NOT NULL) AS molecular_weight, count(*) AS n_merged
    FROM ranked GROUP BY key""", **IDENT))
def merged_molecules(spark, sf):
    return I.merged_molecules(B.parts(spark, sf))


@query("merged_synonyms", "W-122", with_("parts", """
    SELECT DISTINCT new_id AS id, unnest(synonyms) AS synonym FROM ranked JOIN best USING (key)
    UNION SELECT new_id, name FROM ranked JOIN best USING (key) WHERE name <> new_name""", **IDENT))
def merged_synonyms(spark, sf):
    return I.merged_synonyms(B.parts(spark, sf))


@query("role_upsert", "W-123", with_("parts", """
    SELECT DISTINCT coalesce(new_id, id) AS molecule_id, role FROM parts LEFT JOIN mapping ON old_id = id""", **IDENT))
def role_upsert(spark, sf):
    parts = B.parts(spark, sf)
    roles = parts.select(F.col("id").alias("molecule_id"), "role")
    return I.rewrite_components(roles, I.duplicate_map(parts)).distinct()


@query("resolve_by_key", "W-38", """
    WITH known AS (SELECT trim(p_name) AS key, CAST(min(p_partkey) AS VARCHAR) AS id FROM part WHERE length(p_name) % 2 = 0 GROUP BY 1)
    SELECT p_partkey AS id, coalesce(known.id, 'mol-' || substr(md5(trim(p_name)), 1, 12)) AS molecule_id, known.id IS NOT NULL AS matched
    FROM part LEFT JOIN known ON known.key = trim(p_name)""")
def resolve_by_key(spark, sf):
    parts = B.parts(spark, sf)
    known = B.table(spark, sf, "part").where("length(p_name) % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("smiles"))
    return I.resolve_by_key(parts.select("id", "smiles"), known).select("id", "molecule_id", "matched")


@query("resolve_by_key_or_name", "W-39 W-138", """
    WITH byk AS (SELECT p_name AS key, CAST(min(p_partkey) AS VARCHAR) AS kid FROM part WHERE length(p_name) % 2 = 0 GROUP BY 1),
    byn AS (SELECT lower(p_name || ' ' || p_brand) AS nn, CAST(min(p_partkey) AS VARCHAR) AS nid FROM part WHERE length(p_name) % 2 = 0 GROUP BY 1),
    inc AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name END AS key, lower(p_name || ' ' || p_brand) AS nn FROM part)
    SELECT id, coalesce(kid, nid, 'mol-' || substr(md5(nn), 1, 12)) AS molecule_id,
           CASE WHEN kid IS NOT NULL THEN 'key' WHEN nid IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by
    FROM inc LEFT JOIN byk USING (key) LEFT JOIN byn USING (nn)""")
def resolve_by_key_or_name(spark, sf):
    part = B.table(spark, sf, "part")
    name = F.concat(F.upper("p_name"), F.lit("   "), F.col("p_brand"), F.lit(" @ C"))
    incoming = part.select(F.col("p_partkey").alias("id"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("smiles"))
    known = part.where("length(p_name) % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_name").alias("smiles"))
    return I.resolve_by_key_or_name(incoming, known).select("id", "molecule_id", "matched_by")


@query("resolve_with_variations", "W-40", """
    WITH idx AS (SELECT trim(p_name) AS key, CAST(max(p_partkey) AS VARCHAR) AS mid FROM part WHERE length(p_name) % 2 = 0 GROUP BY 1),
    inc AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '= ') ELSE p_name END AS key FROM part)
    SELECT id, coalesce(a.mid, b.mid) AS molecule_id FROM inc LEFT JOIN idx a ON a.key = inc.key LEFT JOIN idx b ON b.key = replace(inc.key, '=', '')""")
def resolve_with_variations(spark, sf):
    part = B.table(spark, sf, "part")
    incoming = part.select(F.col("p_partkey").alias("id"), F.when(
        F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("= "))).otherwise(F.col("p_name")).alias("smiles"))
    known = part.where("length(p_name) % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("smiles"))
    return I.resolve_with_variations(incoming, known).select("id", "molecule_id")


DOCKEY = "SELECT doc_id AS id, md5(lower(trim(text))) AS key FROM documents"


def _documents(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(F.lower(F.trim("text"))).alias("smiles"))


@query("same_as_star", "W-41", f"""
    WITH k AS ({DOCKEY}), h AS (SELECT key, min(id) AS hub FROM k GROUP BY 1)
    SELECT hub AS subject, 'sameAs' AS predicate, id AS object FROM k JOIN h USING (key) WHERE id <> hub
    UNION ALL SELECT id, 'sameAs', hub FROM k JOIN h USING (key) WHERE id <> hub""")
def same_as_star(spark, sf):
    return I.same_as_star(_documents(spark, sf))


@query("same_as_of_labelled", "W-41", f"""
    WITH k AS ({DOCKEY})
    SELECT a.id AS subject, 'sameAs' AS predicate, b.id AS object FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id
    WHERE a.id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def same_as_of_labelled(spark, sf):
    seeds = B.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return I.same_as_of(seeds, _documents(spark, sf))


@query("same_as_closure", "W-158", f"""
    WITH RECURSIVE k AS ({DOCKEY}),
    e AS (SELECT a.id AS a, b.hub AS b FROM k a JOIN (SELECT key, min(id) AS hub FROM k GROUP BY 1 HAVING count(*) > 1) b USING (key) WHERE a.id <> b.hub
          UNION SELECT doc_id, doc_id + 1 FROM labels WHERE toxic = 1),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a AS id, a AS r FROM u UNION SELECT u.a, reach.r FROM u JOIN reach ON u.b = reach.id)
    SELECT id, min(r) AS component FROM reach GROUP BY id""")
def same_as_closure(spark, sf):
    star = I.same_as_star(_documents(spark, sf)).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    chain = B.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return I.connected_components(star.unionByName(chain))


@query("first_source_by_doi", "W-126", """
    SELECT source, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source""")
def first_source_by_doi(spark, sf):
    return I.first_by(B.table(spark, sf, "documents").select("source", "lang", "n_chars", "doc_id"), "source", "doc_id")


@query("first_molecule_by_structure", "W-125", """
    SELECT text_key, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_key, lang, doc_id FROM documents) GROUP BY 1""")
def first_molecule_by_structure(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "lang", "doc_id")
    return I.first_by(docs, "text_key", "doc_id")


@query("composition_groups", "W-124", with_("components", """
    SELECT min(formulation_id) AS first_formulation, count(*) AS formulations FROM (
      SELECT formulation_id, string_agg(molecule_id || ':' || CAST(round(amount * 10000) AS BIGINT), '|' ORDER BY molecule_id || ':' || CAST(round(amount * 10000) AS BIGINT)) AS key
      FROM components GROUP BY 1) GROUP BY key"""))
def composition_groups(spark, sf):
    return I.composition_groups(B.components(spark, sf)).select("first_formulation", "formulations")


@query("keyed_upsert", "W-160", """
    SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1""")
def keyed_upsert(spark, sf):
    events = B.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    early = events.where("event_type IN ('view', 'click')")
    return R.upsert(early, events.where("event_type NOT IN ('view', 'click')"), "user_id", "event_id")


@query("property_type_seed", "W-160 W-153", """
    SELECT 'property_type:' || t AS id, upper(t[1]) || t[2:] AS name, count(*) AS measurements FROM (SELECT event_type AS t FROM events) GROUP BY t""")
def property_type_seed(spark, sf):
    t = F.col("event_type")
    return B.table(spark, sf, "events").groupBy(t).agg(F.count("*").alias("measurements")).select(
        S.property_entity_id(t).alias("id"), S.title_case(t).alias("name"), "measurements")



def _registry(spark, sf):
    """Customers as registry rows: structure = segment and nation, three-or-more synonyms."""
    c = F.col("c_custkey")
    return B.table(spark, sf, "customer").select(
        c.alias("registry_id"), F.concat(F.col("c_mktsegment"), F.col("c_nationkey")).alias("smiles"),
        F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit("InChI"), c).alias("inchi"), F.when(c % 2 == 0, F.concat(F.lit("KEY"), c)).alias("inchi_key"),
        F.concat(F.lit("cas"), c).alias("cas_number"), F.col("c_acctbal").alias("molecular_weight"),
        F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("syn"), c, F.lit("-"), i)).alias("synonyms"))


ENRICHED = """
    WITH reg AS (SELECT *, c_mktsegment || c_nationkey AS smiles, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS rname FROM customer),
    mol AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN s_suppkey * 2 END AS cid,
            CASE WHEN s_nationkey % 3 = 1 THEN ' BUILDING' || s_nationkey END AS smiles FROM supplier),
    by_s AS (SELECT smiles, min(c_custkey) AS k FROM reg GROUP BY 1), by_n AS (SELECT lower(rname) AS n, min(c_custkey) AS k FROM reg GROUP BY 1),
    m AS (SELECT mol.*, a.c_custkey AS k1, b.k AS k2, c.k AS k3, coalesce(a.c_custkey, b.k, c.k) AS k FROM mol
          LEFT JOIN reg a ON a.c_custkey = cid LEFT JOIN by_s b ON b.smiles = trim(mol.smiles) LEFT JOIN by_n c ON c.n = lower(trim(name)))
    SELECT id, CASE WHEN k1 IS NOT NULL THEN 'registry id' WHEN k2 IS NOT NULL THEN 'structure' WHEN k3 IS NOT NULL THEN 'name' END AS matched_by,
           coalesce(cid, k) AS pubchem_cid, 'InChI' || k AS inchi, CASE WHEN k % 2 = 0 THEN 'KEY' || k END AS inchi_key, 'cas' || k AS cas_number, c_acctbal AS molecular_weight,
           CASE WHEN k IS NULL THEN 'own' ELSE 'own|' || array_to_string(list_transform(range(1, {last}), lambda i: 'syn' || k || '-' || i), '|') END AS synonyms
    FROM m LEFT JOIN customer ON c_custkey = k"""


@query("enriched_molecules", "W-52", ENRICHED.replace("{last}", "8"))
def enriched_molecules(spark, sf, new_synonyms=None):
    nation = F.col("s_nationkey")
    mol = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(nation % 3 == 0, F.col("s_suppkey") * 2).alias("pubchem_cid"),
        F.when(nation % 3 == 1, F.concat(F.lit(" BUILDING"), nation)).alias("smiles"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("inchi", "string"), ("inchi_key", "string"), ("cas_number", "string"), ("molecular_weight", "double"))],
        F.array(F.lit("own")).alias("synonyms"))
    out = E.enrich(mol, _registry(spark, sf), new_synonyms)
    return out.select("id", "matched_by", *I.MERGED_FIELDS, F.array_join("synonyms", "|").alias("synonyms"))


@query("enriched_molecules_few_synonyms", "W-52", ENRICHED.replace("{last}", "6"))
def enriched_molecules_few_synonyms(spark, sf):
    return enriched_molecules(spark, sf, 5)


@query("enrichment_provenance", "W-52 W-127", """
    SELECT 'prov-' || md5('enrich:' || s_suppkey) AS id, CAST(s_suppkey AS VARCHAR) AS entity_id, 'Molecule' AS entity_type,
           CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN 'registry' ELSE '' END AS source_ids,
           'external_kg_enrichment' AS extraction_method, 1.0::DOUBLE AS confidence FROM supplier""")
def enrichment_provenance(spark, sf):
    mol = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pubchem_cid"),
        F.concat(F.lit("none"), "s_nationkey").alias("smiles"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("inchi", "string"), ("inchi_key", "string"), ("cas_number", "string"), ("molecular_weight", "double"))],
        F.array().cast("array<string>").alias("synonyms"))
    out = E.enrichment_provenance(E.enrich(mol, _registry(spark, sf)), "registry")
    return out.withColumn("source_ids", F.array_join("source_ids", "|"))


@query("registry_fold", "W-162", """
    SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS label, arg_min(value, event_id) FILTER (value > 50) AS density FROM events GROUP BY 1""")
def registry_fold(spark, sf):
    rows = B.table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"), F.when(F.col("value") > 50, F.col("value")).alias("density"))
    return E.fold_registry(rows, "user_id", ["label", "density"], "event_id")


@query("registry_fold_sets", "W-162", """
    SELECT DISTINCT source, 'lang' AS field, lang AS value FROM documents
    UNION SELECT source, 'size', CASE WHEN n_chars > 5000 THEN 'long' END FROM documents WHERE n_chars > 5000""")
def registry_fold_sets(spark, sf):
    rows = B.table(spark, sf, "documents").select("source", "lang", F.when(F.col("n_chars") > 5000, "long").alias("size"))
    return E.fold_registry_sets(rows, "source", ["lang", "size"])


# --- scalar expressions over whole columns ---


@query("name_normalisation", "W-138", r"""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(lower(url || ' @ Ref /  X')), '\s*@\s*\w+', '', 'g'), '\s*/\s*', '/', 'g'), '\s+', ' ', 'g') AS norm FROM pages""")
def name_normalisation(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", S.normalize_name(F.concat("url", F.lit(" @ Ref /  X"))).alias("norm"))


UNIT_PICK = "CASE p_size % 6 WHEN 0 THEN ' mS/cm' WHEN 1 THEN 'μS/cm' WHEN 2 THEN 'S/cm' WHEN 3 THEN 'S/m' WHEN 4 THEN 'siemens' ELSE 'Millisiemens' END"


def _unit(col):
    cases = [" mS/cm", "μS/cm", "S/cm", "S/m", "siemens"]
    out = F.lit("Millisiemens")
    for i, u in reversed(list(enumerate(cases))):
        out = F.when(col % 6 == i, u).otherwise(out)
    return out


@query("conductivity_units", "W-139 W-146 W-150", f"""
    SELECT p_partkey, m AS multiplier, p_retailprice * m / 1000 BETWEEN 1e-12 AND 1 AS in_range, CASE WHEN contains(u, 'kg') THEN 'm' ELSE 'M' END AS unit FROM (
      SELECT *, CAST(CASE p_size % 6 WHEN 0 THEN 0.001 WHEN 1 THEN 0.000001 WHEN 2 THEN 1 WHEN 3 THEN 0.01 WHEN 4 THEN 1 ELSE 0.001 END AS DOUBLE) AS m, {UNIT_PICK} AS u FROM part)""")
def conductivity_units(spark, sf):
    unit = _unit(F.col("p_size"))
    return B.table(spark, sf, "part").select(
        "p_partkey", S.conductivity_multiplier(unit).alias("multiplier"),
        S.conductivity_guard(F.col("p_retailprice") * S.conductivity_multiplier(unit) / 1000).alias("in_range"),
        S.concentration_unit(unit).alias("unit"))


def _alternation(words):
    return "|".join(words)


@query("material_classifier", "W-140 W-141", f"""
    SELECT doc_id, CASE WHEN regexp_matches(n, '{_alternation(vocab.ELECTRODE_KEYWORDS)}') THEN false
                        WHEN regexp_matches(n, '{_alternation(vocab.ELECTROLYTE_KEYWORDS)}') THEN true ELSE false END AS is_electrolyte,
           CASE WHEN regexp_matches(n, '{_alternation(vocab.SALT_NAME_PARTS)}') THEN 'salt' ELSE 'solvent' END AS role
    FROM (SELECT doc_id, lower(text) AS n FROM documents)""")
def material_classifier(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", S.is_electrolyte(F.col("text"), F.lit("")).alias("is_electrolyte"), S.material_role(F.col("text")).alias("role"))


@query("molecule_type_inference", "W-142", f"""
    SELECT page_id, CASE WHEN regexp_matches(lower(url), '{_alternation(vocab.SALT_INDICATORS)}') THEN 'salt'
                         WHEN contains(url, '/en/') THEN 'salt' WHEN regexp_matches(lower(url), '{_alternation(vocab.SOLVENT_INDICATORS)}') THEN 'solvent' ELSE 'molecule' END AS type FROM pages""")
def molecule_type_inference(spark, sf):
    structure = F.when(F.contains("url", F.lit("/en/")), "[Li+]x").otherwise("C")
    return B.table(spark, sf, "pages").select("page_id", S.infer_molecule_type(F.col("url"), structure).alias("type"))


@query("temperature_and_unit_conversion", "W-143 W-144", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN t IS NULL THEN 25.0 WHEN t > 200 THEN t - 273.15 ELSE t END, 4) AS celsius,
           round(l_extendedprice / 1000.0, 6) AS s_per_cm, CAST(coalesce(t, 25.0) AS DOUBLE) AS given FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity * 10 END AS t FROM lineitem)""")
def temperature_and_unit_conversion(spark, sf):
    t = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") * 10)
    out = B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.celsius(t).alias("celsius"),
        S.ms_to_s_per_cm(F.col("l_extendedprice")).alias("s_per_cm"), S.default_temperature(t).alias("given"))
    return rounded(rounded(out, 4, "celsius"), 6, "s_per_cm")


@query("log_scale_predictions", "W-145", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN c > 1e-12 AND c < 1 THEN c END, 6) AS conductivity,
           CASE WHEN l_quantity > 2 AND l_quantity < 15 THEN l_quantity END AS ie, round(CASE WHEN e > 0 AND e < 1 THEN e END, 6) AS ce FROM (
      SELECT *, pow(10, l_quantity / 10 - 1) / 1000 AS c, 1 - pow(10, l_discount * 20 - 1) AS e FROM lineitem)""")
def log_scale_predictions(spark, sf):
    out = B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.conductivity_from_log(F.col("l_quantity") / 10 - 1).alias("conductivity"), S.ionization_in_range(F.col("l_quantity")).alias("ie"),
        S.efficiency_from_log(F.col("l_discount") * 20 - 1).alias("ce"))
    return rounded(out, 6, "conductivity", "ce")


@query("readable_names", "W-147 W-149", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Ethylene carbonate' WHEN page_id % 3 = 1 THEN 'LiPF6'
             WHEN length(url) > 30 THEN substr(url, 1, 27) || '...' ELSE url END AS name,
           CASE WHEN page_id % 3 = 1 THEN 'Li+' END AS cation, replace(CASE WHEN page_id % 3 = 1 THEN 'LiPF6' ELSE 'x' END, 'Li', '') AS anion FROM pages""")
def readable_names(spark, sf):
    k = F.col("page_id") % 3
    smi = F.when(k == 0, " C1COC(=O)O1").when(k == 1, "[Li+].F[P-](F)(F)(F)(F)F").otherwise(F.col("url"))
    rows = B.table(spark, sf, "pages").select("page_id", smi.alias("smiles"))
    named = S.readable_name(rows, "smiles")
    salt = F.when(F.col("page_id") % 3 == 1, "LiPF6").otherwise("x")
    return named.select("page_id", "name", S.cation_of(F.col("smiles")).alias("cation"), S.anion_of(salt).alias("anion"))


@query("formulation_names", "W-148", """
    SELECT doc_id, array_to_string(list_sort(p)[1:3], '-') || CASE WHEN len(p) > 3 THEN '+' || (len(p) - 3) ELSE '' END || '/' || lang || '-' || doc_id AS name
    FROM (SELECT doc_id, lang, CASE WHEN n_chars % 2 = 0 THEN [source, lang, 'EC', 'DMC', 'PC'] ELSE [source, lang] END AS p FROM documents)""")
def formulation_names(spark, sf):
    parts = F.when(F.col("n_chars") % 2 == 0, F.array("source", "lang", F.lit("EC"), F.lit("DMC"), F.lit("PC"))).otherwise(F.array("source", "lang"))
    return B.table(spark, sf, "documents").select("doc_id", S.composition_name(parts, F.col("lang"), F.col("doc_id")).alias("name"))


@query("publication_dates", "W-151", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published FROM orders""")
def publication_dates(spark, sf):
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("['"), F.dayofmonth(d), F.lit("', '"), F.month(d), F.lit("', '"), F.year(d), F.lit("']")))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("unknown"))
    return B.table(spark, sf, "orders").select("o_orderkey", F.date_format(S.publication_date(text), "yyyy-MM-dd").alias("published"))


@query("deterministic_ids", "W-152", """
    SELECT o_orderkey, 'hyp-' || substr(md5(o_custkey || ':' || 'increases' || ':' || o_orderpriority), 1, 12) AS hypothesis_id,
           'edge-' || substr(md5(o_custkey || ':' || 'increases' || ':' || o_orderpriority), 1, 12) AS edge_id,
           substr(md5(CASE WHEN 'p:' || CAST(round(o_totalprice * 10000) AS BIGINT) < 's:' || CAST(o_custkey * 10000 AS BIGINT)
             THEN 'p:' || CAST(round(o_totalprice * 10000) AS BIGINT) || '|s:' || CAST(o_custkey * 10000 AS BIGINT) END), 1, 16) AS composition_id FROM orders""")
def deterministic_ids(spark, sf):
    s, p, o = F.col("o_custkey").cast("string"), F.lit("increases"), F.col("o_orderpriority")
    entries = F.array(F.concat(F.lit("s:"), S.fixed4(F.col("o_custkey").cast("double"))), F.concat(F.lit("p:"), S.fixed4(F.col("o_totalprice"))))
    return B.table(spark, sf, "orders").select(
        "o_orderkey", S.hypothesis_id(s, p, o).alias("hypothesis_id"), S.edge_id(s, p, o).alias("edge_id"), S.composition_key(entries).alias("composition_id"))


@query("confidence_bands", "W-154", with_("hypotheses", """
    SELECT id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band,
           CASE WHEN abs(confidence) > 0.3 THEN 'strongly' WHEN abs(confidence) > 0.2 THEN 'moderately' ELSE 'weakly' END AS strength FROM hypotheses"""))
def confidence_bands(spark, sf):
    return B.hypotheses(spark, sf).select("id", S.confidence_band(F.col("confidence")).alias("band"), S.correlation_strength(F.col("confidence")).alias("strength"))


@query("lenient_numbers", "W-155", """
    SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events""")
def lenient_numbers(spark, sf):
    text = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return B.table(spark, sf, "events").select("event_id", S.lenient_double(text).alias("value"))
