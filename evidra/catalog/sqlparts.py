"""Named SQL subqueries that mirror ``evidra.bindings``, for the oracle statements."""

from __future__ import annotations

CTE = {
    "components": """
        SELECT l_orderkey AS formulation_id, p_brand AS molecule_id,
               CASE WHEN p_type IN ('STANDARD','MEDIUM') THEN 'solvent'
                    WHEN p_type IN ('ECONOMY','SMALL') THEN 'salt' ELSE 'additive' END AS component_type,
               l_quantity AS amount, l_linenumber AS position
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "order_measurements": """
        SELECT 'm:' || o_orderkey AS id, o_orderkey AS formulation_id, 'totalprice' AS property_type,
               o_totalprice AS value, CAST(NULL AS DOUBLE) AS temperature, CAST(o_orderdate AS DATE) AS measured_on
        FROM orders""",
    "line_wide": """
        SELECT concat_ws(':', 'm', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS line_id,
               l_orderkey AS formulation_id, CAST(p_size AS DOUBLE) AS temperature,
               CAST(l_shipdate AS DATE) AS measured_on, l_quantity, l_extendedprice, l_discount, l_tax
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "line_measurements": """
        SELECT line_id || ':quantity' AS id, formulation_id, 'quantity' AS property_type, l_quantity AS value, temperature, measured_on FROM line_wide
        UNION ALL SELECT line_id || ':extendedprice', formulation_id, 'extendedprice', l_extendedprice, temperature, measured_on FROM line_wide
        UNION ALL SELECT line_id || ':discount', formulation_id, 'discount', l_discount, temperature, measured_on FROM line_wide
        UNION ALL SELECT line_id || ':tax', formulation_id, 'tax', l_tax, temperature, measured_on FROM line_wide""",
    "measurements": "SELECT * FROM order_measurements UNION ALL SELECT * FROM line_measurements",
    "entity_measurements": """
        SELECT event_id AS id, user_id AS entity_id, event_type AS property_type, value,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS temperature, 'S/cm' AS unit
        FROM events""",
    "customers": """
        SELECT c_custkey AS id, c_name AS name,
               CASE WHEN c_mktsegment IN ('MACHINERY','BUILDING') THEN 'solvent'
                    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'salt' ELSE 'other' END AS role
        FROM customer""",
    "parts": """
        SELECT p_partkey AS id, p_name || CASE WHEN p_size > 25 THEN '#' ELSE ' ' END || p_brand AS name,
               ' ' || p_name AS smiles,
               CASE WHEN p_type IN ('STANDARD','MEDIUM') THEN 'solvent'
                    WHEN p_type IN ('ECONOMY','SMALL') THEN 'salt' ELSE 'additive' END AS role,
               CASE WHEN p_size % 5 = 0 THEN 'InChI=' || p_size END AS inchi,
               CASE WHEN p_size % 7 = 0 THEN 'KEY' || p_size END AS inchi_key,
               CASE WHEN p_size % 3 = 0 THEN p_partkey END AS pubchem_cid,
               CASE WHEN p_size % 4 = 0 THEN 'cas-' || p_partkey END AS cas_number,
               CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS molecular_weight,
               [p_brand] AS synonyms
        FROM part""",
    "relations": """
        SELECT 'order:' || formulation_id AS subject,
               CASE component_type WHEN 'solvent' THEN 'hasSolvent' WHEN 'salt' THEN 'hasSalt' ELSE 'hasAdditive' END AS predicate,
               molecule_id AS object FROM components
        UNION ALL SELECT 'order:' || o_orderkey, 'hasMeasurement', 'm:' || o_orderkey FROM orders
        UNION ALL SELECT 'customer:' || o_custkey, 'placed', 'order:' || o_orderkey FROM orders
        UNION ALL SELECT 'supplier:' || s_suppkey, 'inNation', 'nation:' || s_nationkey FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, 'inRegion', 'region:' || n_regionkey FROM nation""",
    "sources": """
        SELECT source AS id, 'Source ' || source AS name,
               CASE WHEN source <> 'src0' THEN '10.5555/' || source END AS doi,
               'https://example.org/' || source AS url, 'dataset' AS source_type, min(doc_id) AS first_doc
        FROM documents GROUP BY source""",
    "provenance": """
        SELECT 'prov:' || d.doc_id AS id,
               CASE WHEN lang = 'en' THEN 'order:' ELSE 'm:' END || d.doc_id AS entity_id,
               CASE WHEN lang = 'en' THEN 'ElectrolyteFormulation' ELSE 'PropertyMeasurement' END AS entity_type,
               CASE WHEN n_chars % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE [source] END AS source_ids,
               CASE WHEN n_chars % 3 = 0 THEN '10.1021/acs.chemmater.4c03196.' || d.doc_id END AS source_doi,
               'row-' || d.doc_id AS source_row_id,
               CASE lang WHEN 'en' THEN 'structured_dataset' WHEN 'fr' THEN 'ml_prediction'
                    WHEN 'de' THEN 'nlp_chemdataextractor' ELSE 'curated' END AS extraction_method,
               CASE lang WHEN 'fr' THEN 0.6::DOUBLE WHEN 'de' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
               coalesce(quality = 1, false) AS validated,
               CAST(DATE '2020-01-01' + CAST(n_chars % 1500 AS INTEGER) AS DATE) AS created_on
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "hypotheses": """
        SELECT 'hyp-' || d.doc_id AS id, source AS subject,
               CASE lang WHEN 'en' THEN 'increases' WHEN 'fr' THEN 'decreases' WHEN 'de' THEN 'coOccursWith' ELSE 'affects' END AS predicate,
               'class:' || (n_chars % 10) AS object,
               CAST(n_chars % 1000 AS DOUBLE) / 1000.0::DOUBLE AS confidence,
               CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'validated'
                    WHEN quality = 0 THEN 'inconclusive' ELSE 'proposed' END AS status,
               CASE WHEN lang IN ('en','es') THEN 'rule_mining' ELSE 'kg_embedding' END AS source,
               n_chars % 2 = 1 AS is_novel, n_chars % 4 = 0 AS passed_time_slice,
               CASE WHEN n_chars % 5 <> 0 THEN CAST(n_chars AS DOUBLE) / 100000.0::DOUBLE END AS model_lift,
               'batch-' || lang AS batch_id
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}

NEEDS = {
    "line_measurements": ["line_wide"],
    "measurements": ["order_measurements", "line_measurements"],
    "relations": ["components"],
}


def t_tail(t: str, dof: str) -> str:
    """Two-sided Student tail as SQL: Simpson's rule on the density after t = tan(u)."""
    steps = 4000
    return f"""(1 - 2 * (
        SELECT sum(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                   * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())
                   * pow(1 + pow(abs({t}) * i / {steps}.0, 2) / {dof}, -({dof} + 1) / 2.0))
               * abs({t}) / {steps}.0 / 3
        FROM range({steps} + 1) steps(i)))"""


def with_(names: str, body: str, **extra: str) -> str:
    """``WITH`` the named shapes (and what they need), then extra named subqueries, then the body."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({CTE[n].strip()})" for n in wanted]
    parts += [f"{n} AS ({text.strip()})" for n, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
