"""Queries on a statute made of the order tables: region = chapter, nation = section, customer = subsection, order = clause."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions import text as X
from codicil.operators import reader as R
from codicil.operators import statute as S
from codicil.sources.tables import spread, table


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.selectExpr(
        "o_orderkey % 4 * 100000000 + o_orderkey AS ord",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 3 = 0 THEN concat(lower(r_name), ' ') ELSE r_name END AS chapter_no",
        "concat(r_name, repeat('x', cast(o_orderkey % 5 AS int))) AS chapter_title",
        "concat(n_nationkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'a' END) AS section_no",
        "concat('Section ', n_nationkey, 'A. ', n_name, repeat('y', cast(o_orderkey % 4 AS int))) AS title",
        "CASE WHEN o_orderkey % 50 = 7 THEN 'omitted' WHEN o_orderkey % 50 = 9 THEN 'substituted' ELSE 'active' END AS section_status",
        "CASE WHEN c_custkey % 4 = 0 THEN 'N/A' ELSE concat('(', c_custkey % 4, ')') END AS subsection_no",
        "CASE WHEN o_orderkey % 900 = 11 THEN 'omitted' ELSE 'active' END AS sub_status",
        "concat('(', substr('abcdeABCDE', cast(o_orderkey % 10 AS int) + 1, 1), ')') AS clause_no",
        "concat('the', '  order is ', o_orderpriority, ' with state ', o_orderstatus, ' and part ', o_orderkey % 20) AS text",
        "cast(o_orderkey % 9 AS string) AS footnote_ref",
        "concat('note  ', o_orderkey % 13) AS note",
    )


FRAGMENTS = """f AS (
SELECT o_orderkey % 4 * 100000000 + o_orderkey AS ord,
  CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 3 = 0 THEN lower(r_name) || ' ' ELSE r_name END AS chapter_no,
  r_name || repeat('x', o_orderkey % 5) AS chapter_title, n_nationkey || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'a' END AS section_no,
  'Section ' || n_nationkey || 'A. ' || n_name || repeat('y', o_orderkey % 4) AS title,
  CASE WHEN o_orderkey % 50 = 7 THEN 'omitted' WHEN o_orderkey % 50 = 9 THEN 'substituted' ELSE 'active' END AS section_status,
  CASE WHEN c_custkey % 4 = 0 THEN 'N/A' ELSE '(' || c_custkey % 4 || ')' END AS subsection_no,
  CASE WHEN o_orderkey % 900 = 11 THEN 'omitted' ELSE 'active' END AS sub_status,
  '(' || substr('abcdeABCDE', (o_orderkey % 10 + 1)::INT, 1) || ')' AS clause_no,
  'the' || '  order is ' || o_orderpriority || ' with state ' || o_orderstatus || ' and part ' || o_orderkey % 20 AS text,
  (o_orderkey % 9)::VARCHAR AS footnote_ref, 'note  ' || o_orderkey % 13 AS note
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT *, upper(trim(chapter_no)) AS chapter, upper(section_no) AS section, upper(subsection_no) AS subsection, upper(clause_no) AS clause FROM f),
r AS (SELECT * FROM g WHERE chapter NOT IN ('', 'N/A')),
sections AS (SELECT chapter, section, arg_max(title, {'l': length(title), 'o': -ord}) AS title,
  coalesce(arg_min(section_status, ord) FILTER (section_status <> 'active'), 'active') AS status, min(ord) AS position FROM r GROUP BY ALL)"""


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters merged from fragments."""
    return S.merge_chapters(fragments(spark, sf_dir))


def chunk_merge_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What falls out with unnamed chapters."""
    return S.dropped_fragments(fragments(spark, sf_dir)).groupBy("section_no").agg(F.count("*").alias("n"))


def section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: sections merged, with their own number taken off the title."""
    m = S.merge_sections(fragments(spark, sf_dir))
    return m.withColumn("title", X.strip_number(F.col("title"), F.col("section")))


def global_section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section once, where it came first."""
    f = fragments(spark, sf_dir).withColumn("section_no", F.regexp_replace("section_no", "^([0-9]+)([Aa])$", "$1-$2"))
    return S.merge_sections(S.place_sections_once(f))


def subsection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: subsections merged."""
    return S.merge_subsections(fragments(spark, sf_dir))


def clause_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: clause texts stitched over their overlaps; a single fragment stays as it is."""
    return S.merge_clauses(fragments(spark, sf_dir)).withColumn("text", F.md5("text"))


def conversation_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: conversations as fragments of one text, and overlapping cuts of documents."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.col("turn").cast("int").alias("turn"), "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.cuts(words, 40, 50)).alias("turn", "text"))
    d = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "turn", "text")
    return c.unionByName(d).groupBy("id").agg(F.md5(S.stitched(F.col("text"), F.col("turn"))).alias("text_md5"))


def note_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: distinct notes of sections, the first of each."""
    n = fragments(spark, sf_dir).select(F.upper("section_no").alias("section"), "footnote_ref", "note", "ord")
    return S.distinct_notes(n, "section").withColumn("note", X.squeeze(F.col("note")))


def chapter_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a chapter's instances (here batches) the one with most content."""
    f = fragments(spark, sf_dir).withColumn("instance", F.floor(F.col("ord") / 100000000))
    return S.richest_chapters(f, F.sum(F.length("title") + F.length("text")))


def chapter_by_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a chapter's instances the one with most sections; a missing number is UNKNOWN."""
    f = fragments(spark, sf_dir).withColumn("instance", F.floor(F.col("ord") / 100000000)).withColumn("chapter_no", F.coalesce("chapter_no", F.lit("UNKNOWN")))
    return S.richest_chapters(f, F.count_distinct("section_no"))


def _subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr(
        "concat(n_nationkey, '.', c_custkey div 3) AS section",
        "concat(n_nationkey, '.', c_custkey div 3, '. ', n_name) AS title",
        "CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE concat('(', c_custkey % 3, ')') END AS subsection",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('section ', n_nationkey, '.', c_custkey div 3, ' - ', lower(n_name)) ELSE c_mktsegment END AS text",
        "c_custkey % 5 % 2 AS n_clauses",
        "c_custkey % 7 % 2 AS n_notes",
        "c_custkey AS ord",
    )


def heading_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsections without repeated headings and contents lines."""
    return S.heading_artefacts(_subsections(spark, sf_dir)).select("section", "subsection", "ord")


def act_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: violations of the merged act, with thresholds of this size."""
    return S.act_violations(S.merge_sections(fragments(spark, sf_dir)), least_chapters=20, least_sections=400)


def carried_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last chapter and section before each batch (here: each order of a customer)."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS doc_id", "o_orderkey AS batch", "CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderstatus END AS chapter_no",
        "o_orderpriority AS chapter_title", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE cast(o_orderkey % 100 AS string) END AS section_no", "o_orderpriority AS title",
    )
    return S.carried_identity(o).select("doc_id", "batch", "carried_chapter", "carried_section")


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's chapter and section heading; capital T and A open chapters and sections here."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return S.heading_paths(lines, "^T", "^[AEIO]").select("doc_id", "line", "chapter_line", "section_line").fillna(-1)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous, next and neighbouring sections."""
    return S.reading_order(S.merge_sections(fragments(spark, sf_dir)).withColumn("document", F.lit("act"))).select("chapter", "section", "previous", "next", "near")


def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's range of sections."""
    return S.chapter_ranges(S.merge_sections(fragments(spark, sf_dir)))


def search_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable text of each section."""
    return R.search_blobs(fragments(spark, sf_dir)).withColumn("blob", F.md5("blob"))


def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six sections in reading order that hold a phrase."""
    return R.search(R.search_blobs(fragments(spark, sf_dir)), "  STATE p and ").select("chapter", "section", "position")


def section_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the section that a reader's query names."""
    return R.jump(S.merge_sections(fragments(spark, sf_dir)), "Section 7a.").select("chapter", "section", "title")


def segmented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions of plain text made from whole documents by numbering their lines and adding footnotes.

    wording: MD5 of all subsections and clauses of a section, in order.
    """
    made = f"transform(split(text, '\\n'), (x, i) -> {_MADE.format(n='i', half='cast(length(x) div 2 as int)', number='cast(i + 1 as string)', chapter='cast(i div 7 + 1 as string)')})"
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(f"array_join({made}, '\\n')").alias("text"))
    subs = S.segment_subsections(S.segment_sections(docs))
    clauses = F.array_join(F.transform("clauses", lambda c: F.concat(c["clause"], F.lit("="), c["text"])), ";")
    row = F.struct("chapter_ord", "section_ord", "sub_ord", F.concat_ws("|", "subsection", "text", clauses).alias("wording"))
    return subs.groupBy("doc_id", "chapter", "section").agg(
        F.count("*").alias("n_subsections"), F.sum(F.size("clauses")).alias("n_clauses"), F.when(F.bool_or((F.col("sub_status") != "active") | (F.size("notes") > 0)), "amended").otherwise("active").alias("status"), F.min("title").alias("title"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["wording"]), "\n")).alias("wording"),
    )


# A line x, numbered n from 0, as a section in chapters of seven; every fifth refers to a footnote of its own.
_MADE = """concat(CASE WHEN {n} % 7 = 0 THEN concat('CHAPTER ', {chapter}, chr(10), 'Head ', {chapter}, chr(10)) ELSE '' END, chr(10), {number}, '. Title—(1) ', substr(x, 1, {half}),
  CASE WHEN {n} % 3 = 0 THEN ' (a) omitted ' ELSE ' (a) first ' END, substr(x, {half} + 1), ' (b) rest (2) see sub-section (1) and (3A) end',
  CASE WHEN {n} % 5 = 0 THEN concat(' [', {number}, ' x]', chr(10), {number}, '. Ins. by Act 21,  w.e.f. 2015') ELSE '' END)"""


def _sanitized_sql(x: str) -> str:
    lines = f"list_transform(string_split(regexp_replace(regexp_replace({x}, '\\b[0-9]+\\*+', '', 'g'), '[0-9]+\\[', '[', 'g'), chr(10)), lambda u: regexp_replace(u, '^\\s+|\\s+$', '', 'g'))"
    kept = f"list_filter({lines}, lambda u: NOT regexp_matches(u, '^[0-9]+$') AND NOT regexp_matches(u, '(?i)^[0-9]+\\s+SECTIONS$'))"
    return f"trim(regexp_replace(regexp_replace(array_to_string({kept}, ' '), '([\\p{{L}}\\p{{N}}_]+)-\\s+([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"


_MADE_SQL = _MADE.format(n="i", half="(length(x) // 2)", number="(i + 1)::VARCHAR", chapter="(i // 7 + 1)::VARCHAR")
_SEGMENTED_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
t AS (SELECT doc_id, string_agg({_MADE_SQL}, chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id),
b AS (SELECT doc_id, regexp_extract_all(text, f, 1) AS refs, regexp_replace(text, f, '', 'g') AS body FROM t, (SELECT '(?m)^\s*([0-9]+)\.\s+(.*?(?:w\.e\.f\.|Act\s+[0-9]+).*?)$' AS f)),
c AS (SELECT doc_id, refs, unnest(range(len(p))) AS chapter_ord, unnest(p) AS part FROM (SELECT doc_id, refs, list_filter(string_split(regexp_replace(body, '(CHAPTER\s+[IVXLCDM0-9]+\s*\n+[^\n]+)', chr(1) || '\1', 'g'), chr(1)), lambda y: starts_with(y, 'CHAPTER')) AS p FROM b)),
h AS (SELECT *, regexp_extract(part, '\A(CHAPTER\s+[IVXLCDM0-9]+)', 1) AS chapter, string_split(regexp_replace(regexp_replace(part, '\ACHAPTER\s+[IVXLCDM0-9]+\s*\n+[^\n]+', ''), '\n([0-9]+[A-Z]?\.\s)', chr(1) || '\1', 'g'), chr(1)) AS p FROM c),
s AS (SELECT doc_id, refs, chapter_ord, chapter, unnest(range(1, len(p))) AS section_ord, unnest(p[2:]) AS raw FROM h),
r AS (SELECT *, regexp_extract(raw, '\A([0-9]+[A-Z]?)\.', 1) AS section, regexp_replace(trim(raw), '\A[0-9]+[A-Z]?\.\s*', '') AS w FROM s),
d AS (SELECT *, regexp_extract(string_split(w, chr(10))[1], '\A([^—-]*)', 1) AS head, string_split(w, chr(10))[1] AS one FROM r),
e AS (SELECT * EXCLUDE (raw), {_sanitized_sql("head")} AS title, trim(substr(one, length(head) + 2)) || substr(w, length(one) + 1) AS body FROM d),
k AS (SELECT *, {_sanitized_sql("body")} AS clean FROM e),
m AS (SELECT *, string_split(regexp_replace(regexp_replace(clean, '(?i)((?:section|sub-sections)\s)\(([0-9]+[A-Z]?\))', '\1' || chr(3) || '\2', 'g'), '(?i)(\([0-9]+[A-Z]?\))', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM k),
n AS (SELECT *, unnest(range(greatest(len(p) - 1, 1))) AS sub_ord, unnest(CASE WHEN len(p) > 1 THEN p[2:] ELSE ['N/A' || chr(2) || clean] END) AS q FROM m),
u AS (SELECT *, len(p) > 1 AS numbered, string_split(q, chr(2))[1] AS subsection, replace(trim(regexp_replace(string_split(q, chr(2))[2], '\A\s+', '')), chr(3), '(') AS content FROM n),
v AS (SELECT *, trim(regexp_replace(content, '\A\[|\]\z', '', 'g')) AS text FROM u),
z AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '(?i)(\([a-z]\)|\([i|v|x]+\))', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:],
  lambda y: {{'clause': string_split(y, chr(2))[1], 'text': trim(regexp_replace({_sanitized_sql("string_split(y, chr(2))[2]")}, '\[\z', ''))}}), lambda y: y.text <> '') AS clauses FROM v),
o AS (SELECT *, CASE WHEN len(clauses) > 0 THEN trim(substr(text, 1, greatest(instr(text, clauses[1].clause) - 1, 0))) ELSE '' END AS lead, contains(lower(text), 'omitted') OR contains(lower(text), 'substituted') OR (numbered AND contains(lower(text), 'subs.')) AS changed,
  len(list_filter(refs, lambda y: contains(CASE WHEN numbered THEN content ELSE body END, y || '***') OR contains(CASE WHEN numbered THEN content ELSE body END, y || '[') OR contains(CASE WHEN numbered THEN content ELSE body END, '[' || y))) > 0 AS noted FROM z)
SELECT doc_id, chapter, section, count(*) AS n_subsections, sum(len(clauses))::BIGINT AS n_clauses, CASE WHEN bool_or(changed OR noted) THEN 'amended' ELSE 'active' END AS status, min(title) AS title,
  md5(string_agg(subsection || '|' || CASE WHEN lead <> '' THEN lead ELSE text END || '|' || array_to_string(list_transform(clauses, lambda y: y.clause || '=' || y.text), ';'), chr(10) ORDER BY chapter_ord, section_ord, sub_ord)) AS wording
FROM o GROUP BY ALL"""


_FNS = (chunk_merge, chunk_merge_dropped, section_merge, global_section_merge, subsection_merge, clause_merge, conversation_stitch, note_union, chapter_by_content, chapter_by_sections, heading_artefacts, act_gate, carried_identity, heading_paths, reading_order, chapter_ranges, search_blobs, local_search, section_jump, segmented_text)
QUERIES = {f.__name__: f for f in _FNS}

_SQUEEZE = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_STITCH = r"""list_reduce({0}, lambda a, b: CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN contains(b, a) THEN b WHEN contains(a, b) THEN a ELSE
  coalesce(list_transform(list_filter(range(least(len(string_split(a, ' ')), len(string_split(b, ' ')), 250), 2, -1),
    lambda k: string_split(a, ' ')[-k:] = string_split(b, ' ')[:k] OR string_split(b, ' ')[-k:] = string_split(a, ' ')[:k])[1:1],
    lambda k: CASE WHEN string_split(a, ' ')[-k:] = string_split(b, ' ')[:k] THEN array_to_string(list_concat(string_split(a, ' '), string_split(b, ' ')[k + 1:]), ' ')
      ELSE array_to_string(list_concat(string_split(b, ' '), string_split(a, ' ')[k + 1:]), ' ') END)[1], a || ' ' || b) END)"""

ORACLE_SQL = {
    "chunk_merge": f"WITH {FRAGMENTS} SELECT chapter, arg_max(chapter_title, {{'l': length(chapter_title), 'o': -ord}}) AS chapter_title, min(ord) AS position, count(*) AS n_fragments FROM r GROUP BY chapter",
    "chunk_merge_dropped": f"WITH {FRAGMENTS} SELECT section_no, count(*) AS n FROM g WHERE chapter IN ('', 'N/A') GROUP BY ALL",
    "section_merge": f"WITH {FRAGMENTS} SELECT chapter, section, regexp_replace(title, '(?i)^(?:section\\s+)?' || section || '[.：:–—-]?\\s*', '') AS title, status, position FROM sections",
    "global_section_merge": f"""WITH {FRAGMENTS}, p AS (SELECT *, first(chapter) OVER w AS c1 FROM g WINDOW w AS (PARTITION BY section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT c1 AS chapter, section, arg_max(title, {{'l': length(title), 'o': -ord}}) AS title, coalesce(arg_min(section_status, ord) FILTER (section_status <> 'active'), 'active') AS status, min(ord) AS position
FROM p WHERE c1 NOT IN ('', 'N/A') GROUP BY ALL""",
    "subsection_merge": f"WITH {FRAGMENTS} SELECT chapter, section, subsection, coalesce(arg_min(sub_status, ord) FILTER (sub_status <> 'active'), 'active') AS status, min(ord) AS position, count(DISTINCT clause) AS n_clauses FROM r GROUP BY ALL",
    "clause_merge": f"WITH {FRAGMENTS}, t AS (SELECT chapter, section, subsection, clause, list({_SQUEEZE.format('text')} ORDER BY ord) AS l, min(text) AS raw, min(ord) AS position FROM r GROUP BY ALL) SELECT chapter, section, subsection, clause, md5(CASE WHEN len(l) = 1 THEN raw ELSE {_STITCH.format('l')} END) AS text, position FROM t",
    "conversation_stitch": rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT 'c' || conv_id AS id, turn, text FROM conversations UNION ALL SELECT 'd' || doc_id, i, array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ') FROM (SELECT doc_id, w, unnest(range(0, len(w) // 40 + 1)) AS i FROM w)),
t AS (SELECT id, list({_SQUEEZE.format("coalesce(text, '')")} ORDER BY turn, text) AS l, min(text) AS raw FROM p GROUP BY id)
SELECT id, md5(CASE WHEN len(l) = 1 THEN raw ELSE {_STITCH.format('l')} END) AS text_md5 FROM t""",
    "note_union": f"WITH {FRAGMENTS} SELECT section, footnote_ref, {_SQUEEZE.format('note')} AS note, min(ord) AS ord FROM g GROUP BY ALL",
    "chapter_by_content": f"""WITH {FRAGMENTS}, i AS (SELECT chapter, ord // 100000000 AS instance, sum(length(title) + length(text))::BIGINT AS score FROM g GROUP BY ALL)
SELECT chapter, arg_max(instance, {{'s': score, 'i': -instance}}) AS instance, max(score) AS score, min(instance) AS position FROM i GROUP BY chapter""",
    "chapter_by_sections": f"""WITH {FRAGMENTS}, i AS (SELECT chapter, ord // 100000000 AS instance, count(DISTINCT section_no) AS score FROM g GROUP BY ALL)
SELECT chapter, arg_max(instance, {{'s': score, 'i': -instance}}) AS instance, max(score) AS score, min(instance) AS position FROM i GROUP BY chapter""",
    "heading_artefacts": r"""
WITH s AS (SELECT n_nationkey || '.' || c_custkey // 3 AS section, n_nationkey || '.' || c_custkey // 3 || '. ' || n_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE '(' || c_custkey % 3 || ')' END AS subsection,
  CASE WHEN c_custkey % 2 = 0 THEN 'section ' || n_nationkey || '.' || c_custkey // 3 || ' - ' || lower(n_name) ELSE c_mktsegment END AS text, c_custkey % 5 % 2 AS n_clauses, c_custkey % 7 % 2 AS n_notes, c_custkey AS ord
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, count(*) OVER (PARTITION BY section) AS n, trim(regexp_replace(lower(regexp_replace(trim(text), '(?i)^(?:section\s+)?' || regexp_escape(section) || '[.：:–—-]?\s*', '')), '[^a-z0-9]+', ' ', 'g')) AS a,
  trim(regexp_replace(lower(regexp_replace(trim(title), '(?i)^(?:section\s+)?' || regexp_escape(section) || '[.：:–—-]?\s*', '')), '[^a-z0-9]+', ' ', 'g')) AS b FROM s)
SELECT section, subsection, ord FROM k WHERE NOT (subsection = 'N/A' AND n_clauses = 0 AND ((n = 1 AND length(text) < 10) OR (n >= 2 AND n_notes = 0 AND a = b)))""",
    "act_gate": f"""WITH {FRAGMENTS}, t AS (SELECT count(DISTINCT chapter) AS c, count(*) AS s FROM sections), n AS (SELECT section AS detail, count(*) AS n FROM sections GROUP BY section)
SELECT 'chapters' AS rule, '' AS detail, c AS n FROM t WHERE c < 20 UNION ALL SELECT 'sections', '', s FROM t WHERE s < 400
UNION ALL SELECT 'number', detail, n FROM n WHERE NOT regexp_matches(detail, '^[0-9]+[A-Z]*$') UNION ALL SELECT 'duplicate', detail, n FROM n WHERE n > 1""",
    "carried_identity": """
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS batch, CASE WHEN o_orderkey % 3 = 2 THEN 'CHAPTER ' || o_orderstatus || ' (' || o_orderpriority || ')' END AS c,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'section ' || o_orderkey % 100 || ' (' || o_orderpriority || ')' END AS s FROM orders)
SELECT doc_id, batch, coalesce(last_value(c IGNORE NULLS) OVER w, 'not yet established') AS carried_chapter, coalesce(last_value(s IGNORE NULLS) OVER w, 'not yet established') AS carried_section
FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "heading_paths": """
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT doc_id, line, coalesce(max(CASE WHEN regexp_matches(text, '^T') THEN line END) OVER w, -1) AS c, coalesce(max(CASE WHEN regexp_matches(text, '^[AEIO]') THEN line END) OVER w, -1) AS s FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, c AS chapter_line, CASE WHEN s >= c THEN s ELSE -1 END AS section_line FROM m""",
    "reading_order": f"""WITH {FRAGMENTS} SELECT chapter, section, lag(section) OVER w AS previous, lead(section) OVER w AS next, string_agg(section, ',') OVER (ORDER BY position ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near
FROM sections WINDOW w AS (ORDER BY position)""",
    "chapter_ranges": f"WITH {FRAGMENTS} SELECT chapter, CASE WHEN count(*) = 1 THEN min(section) ELSE arg_min(section, position) || ' to ' || arg_max(section, position) END AS section_range FROM sections GROUP BY chapter",
    "search_blobs": f"""WITH {FRAGMENTS}, h AS (SELECT chapter, section, lower(string_agg(trim(subsection_no || ' ' || clause_no || ' ' || text || ' ' || note), ' ' ORDER BY ord)) AS body, min(ord) AS position,
  arg_min(chapter_title, ord) AS ct, arg_min(title, ord) AS t FROM r GROUP BY ALL) SELECT chapter, section, position, md5(lower(chapter || ' ' || ct || ' ' || section || ' ' || t || ' ') || body) AS blob FROM h""",
    "local_search": f"""WITH {FRAGMENTS}, h AS (SELECT chapter, section, lower(string_agg(trim(subsection_no || ' ' || clause_no || ' ' || text || ' ' || note), ' ' ORDER BY ord)) AS body, min(ord) AS position,
  arg_min(chapter_title, ord) AS ct, arg_min(title, ord) AS t FROM r GROUP BY ALL) SELECT chapter, section, position FROM h
WHERE contains(lower(chapter || ' ' || ct || ' ' || section || ' ' || t || ' ') || body, 'state p and') ORDER BY position LIMIT 6""",
    "segmented_text": _SEGMENTED_SQL,
    "section_jump": f"WITH {FRAGMENTS} SELECT chapter, section, title FROM sections WHERE section = '7A' ORDER BY position LIMIT 1",
}
