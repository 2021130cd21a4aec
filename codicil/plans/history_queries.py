"""Queries on amendments: parts are provisions in two snapshots, lineitems are amendment operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import history as H
from codicil.operators import lists as L
from codicil.sources.tables import table


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand AS chapter", "cast(p_size AS string) AS section", "CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE concat('(', p_partkey % 4, ')') END AS subsection",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('(', substr('abcde', cast(p_partkey % 5 AS int) + 1, 1), ')') END AS clause", "concat(p_name, ' ', p_type) AS text", "p_partkey AS ord",
    )
    current = p.filter("p_partkey % 7 <> 3 AND chapter <> 'Brand#11' AND NOT (cast(section AS int) % 9 = 4)").drop("p_partkey")
    old = p.filter("p_partkey % 5 <> 2").withColumn("text", F.expr("CASE WHEN p_partkey % 3 <> 1 THEN concat(text, ' as it stood before, with all of the earlier words') ELSE text END")).drop("p_partkey")
    return current, old


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 11 = 0").selectExpr(
        "CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'enacted' END AS act", "cast(p_size AS string) AS section",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('(', p_partkey % 4, ')') END AS subsection",
        "concat('Note ', p_partkey % 5, ' on sub-section ( ', p_partkey % 4, ' ), Clause (', substr('abcde', cast(p_partkey % 5 AS int) + 1, 1), ')') AS note", "p_partkey AS ord",
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_ord", "l_linenumber AS op_ord", "concat('Amendment Act ', 2000 + l_suppkey % 20) AS title", "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE cast(l_suppkey % 50 AS string) END AS act_number",
        "cast(l_partkey % 50 + 1 AS string) AS principal_section", "CASE l_linenumber % 4 WHEN 0 THEN 'inserted' WHEN 1 THEN 'omitted' WHEN 2 THEN 'substituted' ELSE 'amended' END AS operation",
        "CASE l_partkey % 4 WHEN 0 THEN concat('In section ', l_partkey % 50 + 1) WHEN 1 THEN concat('section ', l_partkey % 50 + 1, ', sub-section (', l_suppkey % 4, ')')"
        " WHEN 2 THEN concat('section ', l_partkey % 50 + 1, ', clause (', substr('abcde', cast(l_suppkey % 5 AS int) + 1, 1), ')') ELSE concat('subsection (', l_suppkey % 4, ') in part') END AS target",
        "CASE l_linenumber % 3 WHEN 0 THEN concat(l_suppkey % 9 + 1, '. In the Act') WHEN 1 THEN '(ii) words' ELSE '' END AS source_excerpt",
        "CASE l_linenumber % 2 WHEN 0 THEN concat('PDF page ', l_suppkey % 30) ELSE '' END AS page_reference",
        "CASE l_linenumber % 5 WHEN 0 THEN 'Not specified' WHEN 1 THEN '25th May, 2015' ELSE '' END AS effective_date", "'' AS enacted_text",
    )


def citation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation index."""
    return H.citation_index(operations(spark, sf_dir))


def section_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's different citations in order, joined."""
    index = H.citation_index(H.first_worded(operations(spark, sf_dir)))
    return L.digests(L.listed(index, "section", F.col("citation"), ["doc_ord", "op_ord"]), "section").select("section", F.col("md5").alias("citations"), F.col("chars").cast("int").alias("chars"))


def target_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations whose target names a clause or subsection."""
    current, _ = snapshots(spark, sf_dir)
    items = current.select("section", F.when(F.col("clause").isNull(), "subsection").otherwise("clause").alias("level"), F.coalesce("clause", "subsection").alias("id")).distinct()
    index = H.citation_index(operations(spark, sf_dir))
    return H.matches(items, index, "level", "id").groupBy("section", "level", "id").agg(F.count("*").alias("n"), F.count_if("_omits").alias("n_removing"))


def version_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the enacted wording adds to the current one (flagship)."""
    current, old = snapshots(spark, sf_dir)
    return H.reconcile(current, old, notes(spark, sf_dir), H.citation_index(operations(spark, sf_dir)), shown=F.md5)


def note_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved notes back-filled from ordinances."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("section"), F.when(F.col("p_partkey") % 3 == 0, H.UNRESOLVED).otherwise(F.col("p_name")).alias("note"))
    notes, lists = H.back_fill(p, operations(spark, sf_dir))
    filled = notes.join(L.digests(lists, "section").select(F.col("section").alias("note_list"), "md5"), "note_list", "left")
    return filled.select("id", "section", F.coalesce("md5", F.md5("note")).alias("note"))


def principal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents refer to a section of the principal Act."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document", "concat('In section ', o_custkey % 60, 'a of the principal Act, and sections ', o_custkey % 7, ' of the Companies Act, 2013; section 3 of another') AS text")
    return L.digests(H.section_references(o), "section", ",").select("section", F.col("md5").alias("documents"))


def operation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3: operations that break a rule."""
    ops = operations(spark, sf_dir).withColumn("principal_section", F.expr("CASE WHEN doc_ord % 9 = 0 THEN concat('s', principal_section) ELSE principal_section END"))
    return H.operation_violations(ops).groupBy("operation", F.coalesce("violation", F.lit("-")).alias("violation")).agg(F.count("*").alias("n"))


_FNS = (citation_index, section_citations, target_matches, version_reconciliation, note_back_fill, principal_references, operation_gate)
QUERIES = {f.__name__: f for f in _FNS}

OPS = """
ops AS (SELECT l_orderkey AS doc_ord, l_linenumber AS op_ord, 'Amendment Act ' || 2000 + l_suppkey % 20 AS title, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE (l_suppkey % 50)::VARCHAR END AS act_number,
  (l_partkey % 50 + 1)::VARCHAR AS principal_section, CASE l_linenumber % 4 WHEN 0 THEN 'inserted' WHEN 1 THEN 'omitted' WHEN 2 THEN 'substituted' ELSE 'amended' END AS operation,
  CASE l_partkey % 4 WHEN 0 THEN 'In section ' || l_partkey % 50 + 1 WHEN 1 THEN 'section ' || l_partkey % 50 + 1 || ', sub-section (' || l_suppkey % 4 || ')'
    WHEN 2 THEN 'section ' || l_partkey % 50 + 1 || ', clause (' || substr('abcde', (l_suppkey % 5 + 1)::INT, 1) || ')' ELSE 'subsection (' || l_suppkey % 4 || ') in part' END AS target,
  CASE l_linenumber % 3 WHEN 0 THEN l_suppkey % 9 + 1 || '. In the Act' WHEN 1 THEN '(ii) words' ELSE '' END AS source_excerpt,
  CASE l_linenumber % 2 WHEN 0 THEN l_suppkey % 30 ELSE NULL END AS page, CASE l_linenumber % 5 WHEN 1 THEN '25th May, 2015' ELSE '' END AS day FROM lineitem),
idx AS (SELECT principal_section AS section, doc_ord, op_ord, operation, target, upper(operation[1]) || operation[2:] || ' by ' || title || CASE WHEN act_number <> '' THEN ' (Act ' || act_number || ')' ELSE '' END || ', ' || target
  || CASE l3 WHEN 0 THEN ', source item ' || regexp_extract(source_excerpt, '^[0-9]+') WHEN 1 THEN ', source item (ii)' ELSE '' END || CASE WHEN page IS NOT NULL THEN ', PDF page ' || page ELSE '' END
  || CASE WHEN day <> '' THEN '; effective ' || day ELSE '' END || '.' AS citation FROM (SELECT *, op_ord % 3 AS l3 FROM ops))""".replace("|| 2000 + l_suppkey % 20", "|| (2000 + l_suppkey % 20)").replace("|| l_partkey % 50 + 1", "|| (l_partkey % 50 + 1)").replace("THEN l_suppkey % 9 + 1 ||", "THEN (l_suppkey % 9 + 1) ||")

PARTS = """
p AS (SELECT p_partkey, p_brand AS chapter, p_size::VARCHAR AS section, CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE '(' || p_partkey % 4 || ')' END AS subsection,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '(' || substr('abcde', (p_partkey % 5 + 1)::INT, 1) || ')' END AS clause, p_name || ' ' || p_type AS text, p_partkey AS ord FROM part),
cur AS (SELECT * REPLACE (upper(chapter) AS chapter) FROM p WHERE p_partkey % 7 <> 3 AND chapter <> 'Brand#11' AND NOT (section::INT % 9 = 4)),
old AS (SELECT * REPLACE (upper(chapter) AS chapter, CASE WHEN p_partkey % 3 <> 1 THEN text || ' as it stood before, with all of the earlier words' ELSE text END AS text) FROM p WHERE p_partkey % 5 <> 2)"""

_PAT = r"""CASE level WHEN 'section' THEN '(?i)\bsection\s+' || regexp_escape(trim(id, '()')) || '\b' WHEN 'clause' THEN '(?i)\b(?:sub-?clause|clause)\s*\(\s*' || regexp_escape(trim(id, '()')) || '\s*\)'
  ELSE '(?i)\b(?:sub-?section|subsection)\s*\(\s*' || regexp_escape(trim(id, '()')) || '\s*\)' END"""
_NAMES = rf"""CASE WHEN level = 'section' OR (level = 'subsection' AND id = 'N/A') THEN regexp_matches(trim(target), '(?i)^(?:(?:in|after|before)\s+)?section\s+' || regexp_escape(section) || '\s*$') ELSE regexp_matches(target, {_PAT}) END"""
_REMOVES = rf"(operation = 'omitted' AND regexp_matches(trim(target), {_PAT} || '[ ,;:-]*$'))"
_KEY = r"trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"

ORACLE_SQL = {
    "citation_index": f"WITH {OPS} SELECT * FROM idx",
    "section_citations": f"WITH {OPS}, f AS (SELECT section, citation, min({{'d': doc_ord, 'o': op_ord}}) AS first FROM idx GROUP BY ALL), j AS (SELECT section, string_agg(citation, '; ' ORDER BY first, citation) AS c FROM f GROUP BY section) SELECT section, md5(c) AS citations, length(c) AS chars FROM j",
    "target_matches": f"WITH {OPS}, {PARTS}, items AS (SELECT DISTINCT section, CASE WHEN clause IS NULL THEN 'subsection' ELSE 'clause' END AS level, coalesce(clause, subsection) AS id FROM cur), h AS (SELECT section, level, id, operation, target, {_REMOVES} AS omits FROM items JOIN (SELECT DISTINCT section, operation, target FROM idx) USING (section) WHERE {_NAMES}) SELECT section, level, id, count(*) AS n, count_if(omits) AS n_removing FROM h JOIN idx USING (section, operation, target) GROUP BY ALL",
    "version_reconciliation": rf"""WITH {OPS}, {PARTS},
notes AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'enacted' END AS act, p_size::VARCHAR AS s, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '(' || p_partkey % 4 || ')' END AS sub,
  'Note ' || p_partkey % 5 || ' on sub-section ( ' || p_partkey % 4 || ' ), Clause (' || substr('abcde', (p_partkey % 5 + 1)::INT, 1) || ')' AS note, p_partkey AS note_ord FROM part WHERE p_partkey % 11 = 0),
latest AS (SELECT chapter, section, subsection, coalesce(clause, '') AS c, arg_max(text, ord) AS current_text FROM cur GROUP BY ALL),
item AS (SELECT chapter, section, subsection, clause, arg_max(text, ord) AS text FROM old GROUP BY ALL),
i2 AS (SELECT item.*, item.chapter IN (SELECT chapter FROM cur) AS in_c, EXISTS (FROM cur x WHERE x.chapter = item.chapter AND x.section = item.section) AS in_s,
  EXISTS (FROM cur x WHERE x.chapter = item.chapter AND x.section = item.section AND x.subsection = item.subsection) AS in_u,
  EXISTS (FROM item x WHERE x.chapter = item.chapter AND x.section = item.section AND x.subsection = item.subsection AND x.clause IS NOT NULL) AS has_clauses, latest.current_text
  FROM item LEFT JOIN latest ON latest.chapter = item.chapter AND latest.section = item.section AND latest.subsection = item.subsection AND latest.c = coalesce(item.clause, '')),
items AS (
  SELECT DISTINCT 'section' AS level, chapter, section, NULL::VARCHAR AS subsection, NULL::VARCHAR AS clause, NULL::VARCHAR AS text, false AS there, NULL::VARCHAR AS current_text FROM i2 WHERE in_c AND NOT in_s
  UNION ALL SELECT 'subsection', chapter, section, subsection, NULL, max(text) FILTER (clause IS NULL), false, NULL FROM i2 WHERE in_s AND NOT in_u GROUP BY chapter, section, subsection
  UNION ALL SELECT 'clause', chapter, section, subsection, clause, text, current_text IS NOT NULL, current_text FROM i2 WHERE in_u AND clause IS NOT NULL
  UNION ALL SELECT 'subsection', chapter, section, subsection, NULL, text, true, current_text FROM i2 WHERE in_u AND clause IS NULL AND NOT has_clauses),
k AS (SELECT row_number() OVER () AS k, *, coalesce(clause, subsection, section) AS id FROM items),
m AS (SELECT k, section, operation, target, {_REMOVES} AS omits FROM k JOIN (SELECT DISTINCT section, operation, target FROM idx) USING (section) WHERE {_NAMES}),
cited AS (SELECT k, citation AS note, {{'kind': 1, 'a': doc_ord, 'b': op_ord::BIGINT}} AS o, omits FROM m JOIN idx USING (section, operation, target)),
local AS (SELECT k, note, {{'kind': 0, 'a': (sub IS NOT NULL)::BIGINT, 'b': note_ord}} AS o FROM k JOIN notes ON s = section AND act = CASE WHEN level = 'section' THEN 'enacted' ELSE 'current' END AND (sub IS NULL OR sub = subsection)
  WHERE level = 'section' OR (level = 'subsection' AND id = 'N/A') OR regexp_matches(note, {_PAT})),
said AS (SELECT k, note, min(o) AS o FROM (SELECT k, note, o FROM cited UNION ALL SELECT k, note, o FROM local) GROUP BY ALL),
j AS (SELECT k, string_agg(note, '; ' ORDER BY o, note) AS source_note FROM said GROUP BY k), om AS (SELECT k, bool_or(omits) AS omits FROM cited GROUP BY k),
n AS (SELECT k.*, coalesce(source_note, '') AS source_note, CASE WHEN source_note IS NULL THEN NULL WHEN omits THEN 'omitted' ELSE 'substituted' END AS change_type FROM k LEFT JOIN j USING (k) LEFT JOIN om USING (k))
SELECT level, chapter, section, subsection, clause, CASE WHEN source_note <> '' THEN 'historical_' ELSE 'restored_' END || level AS action, change_type, md5(source_note) AS source_note, text FROM n WHERE NOT there
UNION ALL SELECT level, chapter, section, subsection, clause, CASE WHEN level = 'clause' THEN 'historical_clause' ELSE 'historical_version' END, change_type, md5(source_note), text FROM n
  WHERE there AND source_note <> '' AND {_KEY.format('text')} <> {_KEY.format('current_text')}
UNION ALL SELECT DISTINCT 'chapter', chapter, NULL, NULL, NULL, 'chapter_appended', NULL, md5(''), NULL FROM i2 WHERE NOT in_c""",
    "note_back_fill": f"""WITH {OPS}, o AS (SELECT principal_section AS s, doc_ord, op_ord, title || ': ' || operation || ' ' || target || ' (section ' || principal_section || CASE WHEN page IS NOT NULL THEN ', PDF page ' || page ELSE '' END || ')' AS note FROM ops),
f AS (SELECT s, note, min({{'d': doc_ord, 'o': op_ord}}) AS first FROM o GROUP BY ALL), j AS (SELECT s, string_agg(note, '; ' ORDER BY first, note) AS note FROM f GROUP BY s)
SELECT p_partkey AS id, p_size::VARCHAR AS section, md5(CASE WHEN p_partkey % 3 = 0 THEN coalesce(j.note, 'Amendment source was not identified in the parsed footnotes.') ELSE p_name END) AS note FROM part LEFT JOIN j ON s = p_size::VARCHAR""",
    "principal_references": """WITH f AS (SELECT o_orderkey AS document, unnest([1, 2]) AS n, unnest([(o_custkey % 60) || 'A', (o_custkey % 7)::VARCHAR]) AS section FROM orders)
SELECT section, md5(string_agg(document, ',' ORDER BY document, n)) AS documents FROM f GROUP BY section""",
    "operation_gate": f"""WITH {OPS} SELECT operation, CASE WHEN doc_ord % 9 = 0 THEN 'section' WHEN operation <> 'omitted' AND source_excerpt = '' THEN 'wording' ELSE '-' END AS violation, count(*) AS n FROM ops GROUP BY ALL""",
}
