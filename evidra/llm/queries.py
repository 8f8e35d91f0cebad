"""One query per operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidra.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op4_token_counts(spark, sf_dir):
    from evidra.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), bpe_file())


@query()
def op5_token_files(spark, sf_dir):
    from evidra.llm.rans import token_digests

    return token_digests(table(spark, sf_dir, "documents"), bpe_file(), end_id=2)


@query()
def op10_packing(spark, sf_dir):
    from evidra.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), bpe_file(), end_id=0)


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_ASCII)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.seen), w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id
""")
def op7_jaccard_join(spark, sf_dir):
    from evidra.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
""")
def op3_warc_index(spark, sf_dir):
    from evidra.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


@query()
def op9_string_tiling(spark, sf_dir):
    from evidra.llm.tiling import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_quality_rules(spark, sf_dir):
    from evidra.llm.weak_quality import quality

    return quality(table(spark, sf_dir, "documents"))


@query()
def op1_language_id(spark, sf_dir):
    from evidra.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


@query()
def op6_main_text(spark, sf_dir):
    from evidra.llm.html_main import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query()
def op2_lm_scores(spark, sf_dir):
    from evidra.llm.lm import scored

    return scored(table(spark, sf_dir, "documents"))


_CRC = """xor(list_reduce([4294967295::BIGINT] || [ord(c)::BIGINT FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
    lambda s, b: xor(s >> 8, list_reduce([xor(s, b) & 255, 1, 1, 1, 1, 1, 1, 1, 1],
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))), 4294967295)"""


@query(f"""
WITH RECURSIVE src AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS k FROM conversations
),
d AS (
  SELECT c, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src WHERE k <> 0
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS letter,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
  FROM d
),
r AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(letter) OVER (PARTITION BY c ORDER BY pos) AS before
  FROM o
),
ins(p, q, cost, s) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
moves(p, q, letter) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
edits AS (
  SELECT c, pos, p, p AS q, 3 AS cost, 'D' AS s FROM r, (VALUES (0), (1), (2), (3)) x(p)
  UNION ALL
  SELECT c, pos, p, q, (CASE WHEN r.letter = m.letter THEN 0 ELSE 2 END) + (fault = 'truncated')::INT, CASE WHEN r.letter = m.letter THEN 'K' ELSE 'R' END
  FROM r JOIN moves m ON fault NOT IN ('blank', 'duplicate') AND (r.letter = m.letter OR m.letter <> 's')
),
closed AS (SELECT c, pos, e.p, i.q, e.cost + i.cost AS cost, e.s || i.s AS s FROM edits e JOIN ins i ON i.p = e.q),
dp(c, pos, st, best) AS (
  SELECT DISTINCT c, 0::BIGINT, q, {{'cost': cost, 'audit': s}} FROM r, ins WHERE p = 0
  UNION ALL
  SELECT d.c, d.pos + 1, x.q, min({{'cost': d.best.cost + x.cost, 'audit': d.best.audit || x.s}})
  FROM dp d JOIN closed x ON x.c = d.c AND x.pos = d.pos + 1 AND x.p = d.st GROUP BY ALL
),
n AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY c
),
b AS (SELECT dp.c, min(best) AS best FROM dp JOIN n ON n.c = dp.c AND n.n = dp.pos WHERE st IN (0, 3) GROUP BY dp.c),
l AS (
  SELECT c, i, e, sum((e <> 'I')::INT) OVER w AS pos, sum((e <> 'D')::INT) OVER w - 1 AS place, (length(replace(audit, 'D', '')) % 2) AS head
  FROM (SELECT c, best.audit AS audit, unnest(string_split(best.audit, '')) AS e, unnest(range(length(best.audit))) AS i FROM b)
  WINDOW w AS (PARTITION BY c ORDER BY i)
),
t AS (
  SELECT l.c, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - head) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS t
  FROM l LEFT JOIN r ON r.c = l.c AND r.pos = l.pos WHERE e <> 'D' GROUP BY l.c
)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM src) s LEFT JOIN n USING (c) LEFT JOIN b USING (c) LEFT JOIN t USING (c)
""")
def op12_conversation_repair(spark, sf_dir):
    from evidra.llm.repair import repair_audit

    return repair_audit(table(spark, sf_dir, "conversations"))


@query("""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM docs),
w AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM docs
),
k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT d) >= 30),
n AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(whole) AS whole FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.whole + 5)) // (v.whole + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN t USING (lang, source)
),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS f
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS rank FROM o)
SELECT lang, source, part, item, f::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
""")
def op13_source_divergence(spark, sf_dir):
    from evidra.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


@query()
def op11_personal_data(spark, sf_dir):
    from evidra.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))
