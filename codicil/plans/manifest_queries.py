"""Queries on manifests: events as log rows, pages as stored listings, parts and urls as names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions import names as N
from codicil.operators import manifest as M
from codicil.sources.tables import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(user_id AS string) END AS document_id", "date_format(ts, 'yyyy-MM-dd') AS date", "concat('matter ', user_id) AS particulars", "event_type AS status"
    )


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after all rows."""
    return M.upsert(_rows(spark, sf_dir), ["particulars"]).select("document_id", "particulars", "date", "status", "seq", "position")


def composite_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each composite key."""
    return M.first_of_each(_rows(spark, sf_dir), ["document_id", "status"], "seq")


def resume_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not finished yet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return M.pending(docs, docs.filter("doc_id % 3 = 0").select("doc_id"), ["doc_id"])


def resume_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches without a valid checkpoint."""
    b = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "format_string('pages-%04d-%04d', o_orderkey % 50, o_orderkey % 50 + 19) AS key").distinct()
    c = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_custkey AS doc_id", "format_string('pages-%04d-%04d', o_orderkey % 50, o_orderkey % 50 + 19) AS key", "o_orderstatus AS body")
    return M.valid_batches(b, c, F.col("body") != "F")


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose original file is new, the first of each."""
    o = table(spark, sf_dir, "orders")
    have = o.filter("o_orderkey % 3 = 0").selectExpr("CASE o_orderkey % 4 WHEN 0 THEN concat('x (', o_custkey, ').PDF') WHEN 1 THEN concat('x (a) (', o_custkey, ') [2].pdf') WHEN 2 THEN concat(o_custkey, '.pdf') ELSE 'other.txt' END AS filename")
    return M.new_originals(o.selectExpr("o_orderkey AS seq", "concat(o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.pdf' END) AS original"), have, "seq")


def document_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the manifest, else from the name, else the stem."""
    p = table(spark, sf_dir, "part")
    files = p.selectExpr("concat('/in/', p_brand, '/', p_name, CASE WHEN p_partkey % 3 = 0 THEN concat(' (', p_partkey, ')') ELSE concat(' ', p_partkey) END, '.pdf') AS path")
    m = p.filter("p_partkey % 5 = 0").selectExpr("concat('/in/', p_brand, '/', p_name, CASE WHEN p_partkey % 3 = 0 THEN concat(' (', p_partkey, ')') ELSE concat(' ', p_partkey) END, '.pdf') AS filename", "CASE WHEN p_partkey % 2 = 0 THEN concat('D', p_partkey) ELSE '' END AS document_id", "p_partkey AS seq")
    return M.document_ids(files, m)


ALIASES = [("s.no.", "s. no."), ("sr no", "s. no."), ("ministry", "ministry / organization"), ("ministry/organization", "ministry / organization"), ("date of issue", "issue date"), ("gazette no.", "gazette id")]


def header_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by canonical header."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS row_id", "CASE WHEN s_suppkey % 2 = 0 THEN array('Sr  No', 'Ministry/Organisation', 'Date of Issue', 'Remark') ELSE array('', 'MINISTRY', 'Gazette No.') END AS headers",
        "array(cast(s_suppkey AS string), s_name, concat(' ', s_nationkey, ' '), 'x') AS cells",
    )
    return M.canonical_rows(rows, spark.createDataFrame(ALIASES, "alias string, header string"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of stored pages."""
    return M.harvest_links(table(spark, sf_dir, "pages"))


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows accepted or rejected with a reason."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE cast(o_custkey AS string) END AS document_id",
        "CASE o_orderkey % 4 WHEN 0 THEN array('No data available in table') WHEN 1 THEN array(o_orderpriority, concat(o_orderkey % 28 + 1, '/7/2019')) WHEN 2 THEN array(concat('dated ', o_orderkey % 28 + 1, '/12/2020'), 'x') ELSE array('none') END AS cells",
    )
    return M.listing_rows(rows).select("seq", "document_id", F.coalesce("date", F.lit("")).alias("date"), F.coalesce("reason", F.lit("")).alias("reason"))


def listing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6: parsed against listed rows."""
    links = M.harvest_links(table(spark, sf_dir, "pages"))
    return M.listing_gap(links, table(spark, sf_dir, "pages").selectExpr("page_id", "page_id % 12 AS listed"), "page_id")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's summary from its log."""
    log = table(spark, sf_dir, "events").selectExpr("CASE event_type WHEN 'view' THEN 'downloaded' WHEN 'click' THEN 'already-exists' WHEN 'error' THEN 'ERROR: timeout' ELSE 'other' END AS status", "event_id % 30 AS pages")
    return M.run_summary(log)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from dates and subjects, short and long."""
    p = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(doc_id % 28 + 1, CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '-' END, doc_id % 12 + 1, CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '-' END, 2000 + doc_id % 20) AS day", "concat(substring(text, 1, cast(10 + doc_id % 400 AS int)), ' | 1.5 MB') AS subject", "source")
    return p.select("doc_id", N.iso_date(F.col("day")).alias("iso"), F.md5(N.dated_name(F.col("day"), F.col("subject"))).alias("dated"), F.md5(N.typed_name(F.col("day"), F.col("source"), F.col("subject"))).alias("typed"), F.md5(N.safe_stem(N.component(F.col("subject")), F.col("subject"))).alias("stem"))


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose fields give way one after the other."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "substring(text, 1, cast(doc_id % 200 AS int)) AS a", "substring(text, 50, cast(doc_id % 150 AS int)) AS b", "source", "'03/04/2015' AS day")
    fields = [F.col("doc_id").cast("string"), F.col("a"), F.col("source"), F.lit("office"), F.col("b"), F.lit("Extra"), F.lit("Part"), F.col("day"), F.col("day"), F.lit("G-1")]
    made = d.select("doc_id", N.rule_name(F.col("a"), F.lit("Rule 1 to 4"), F.col("day"), F.col("b")).alias("rule"), N.gazette_name(fields, F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("gazette"))
    return made.withColumn("rule_bytes", F.octet_length("rule")).withColumn("gazette_bytes", F.octet_length("gazette"))


def small_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parsers of fields."""
    from codicil.functions.text import title_label

    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat(lpad(event_id % 33, 2, '0'), '/', lpad(event_id % 14, 2, '0'), '/2015') AS day", "CASE event_id % 4 WHEN 0 THEN concat('attachment; filename*=UTF-8''''a%20', event_id, '.pdf') WHEN 1 THEN concat('attachment; filename=\"b ', event_id, '.pdf\"') WHEN 2 THEN concat('filename=c', event_id, '; x') ELSE '' END AS disposition",
        "CASE event_id % 5 WHEN 0 THEN 'application/msword' WHEN 1 THEN 'application/vnd.ms-excel' WHEN 2 THEN 'application/zip' WHEN 3 THEN 'text/html' ELSE 'application/pdf' END AS content_type",
        "concat('Showing ', event_id % 90 + 1, '-', event_id % 90 + 10, ' of ', event_id) AS shown", "concat('act:section:', event_id % 400, 'A:clause:b') AS provision", "concat(event_type, ' ', user_id) AS message", "event_type",
    )
    r = N.shown_range(F.col("shown"))
    return e.select(
        "event_id", F.date_format(N.checked_date(F.col("day")), "yyyy-MM-dd").alias("day"), N.masked_date(F.regexp_replace("day", "/", "")).alias("masked"), N.attachment_name(F.col("disposition")).alias("attachment"), N.extension(F.col("content_type")).alias("ext"),
        (r["last"] - r["first"]).alias("rows_shown"), r["total"].alias("total"), N.section_of(F.col("provision")).alias("section"), N.has_marker(F.col("message")).alias("transient"), title_label(F.concat("event_type", F.lit("_rule"))).alias("label"),
        N.document_kind(F.concat(F.col("event_type"), F.element_at(F.array(F.lit("_Bare.pdf"), F.lit("_Principal"), F.lit("_Ordinance"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int")))).alias("kind"),
        N.document_url(F.col("event_id").cast("string"), F.col("event_type"), "/document").alias("url"), F.length(N.body_start(F.encode(F.concat(F.lit("xx%PDF-"), F.col("event_type")), "UTF-8"))).alias("body"),
    )


_FNS = (manifest_upsert, composite_dedup, resume_documents, resume_batches, originals, document_id_resolution, header_aliases, page_links, listing_rows, listing_gaps, run_summary, file_names, long_names, small_parsers)
QUERIES = {f.__name__: f for f in _FNS}

_ROWS = """r AS (SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id::VARCHAR END AS document_id, strftime(ts, '%Y-%m-%d') AS date, 'matter ' || user_id AS particulars, event_type AS status FROM events)"""
_SQ = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_COMP = r"""coalesce(nullif(trim(regexp_replace(regexp_replace({}, '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), '-{{2,}}', '-', 'g'), ' .'), ''), 'NA')"""
_CUT = "CASE WHEN strlen({0}) <= {1} THEN {0} ELSE rtrim(list_filter(list_transform(range(least(length({0}), {1})::BIGINT, -1, -1), lambda k: left({0}, k)), lambda x: strlen(x) <= {1})[1], '{2}') END"
_LINKS = r"""l AS (SELECT page_id, unnest(range(len(a))) AS position, unnest(a) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href=["''][^"'']*["''][^>]*>.*?</a>') AS a FROM pages))"""
_FILE = "'/in/' || p_brand || '/' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_partkey || ')' ELSE ' ' || p_partkey END || '.pdf'"

ORACLE_SQL = {
    "manifest_upsert": f"""WITH {_ROWS}, ids AS (SELECT particulars, min(document_id) AS id, count(DISTINCT document_id) AS n FROM r WHERE document_id IS NOT NULL GROUP BY particulars),
k AS (SELECT r.*, CASE WHEN r.document_id IS NOT NULL THEN 'i' || r.document_id WHEN n = 1 THEN 'i' || id ELSE 'k' || r.particulars END AS k FROM r LEFT JOIN ids USING (particulars) WHERE r.document_id IS NOT NULL OR coalesce(n, 0) <= 1)
SELECT x.document_id AS document_id, x.particulars AS particulars, x.date AS date, x.status AS status, x.seq AS seq, position FROM (SELECT arg_max(struct_pack(document_id, particulars, date, status, seq), seq) AS x, min(seq) AS position FROM k GROUP BY k)""",
    "composite_dedup": f"WITH {_ROWS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY document_id, status ORDER BY seq) = 1",
    "resume_documents": "SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0",
    "resume_batches": """SELECT DISTINCT o_custkey AS doc_id, printf('pages-%04d-%04d', o_orderkey % 50, o_orderkey % 50 + 19) AS key FROM orders o
WHERE NOT EXISTS (FROM orders x WHERE x.o_orderkey % 2 = 0 AND x.o_orderstatus <> 'F' AND x.o_custkey = o.o_custkey AND x.o_orderkey % 50 = o.o_orderkey % 50)""",
    "originals": """WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 < 3) SELECT o_orderkey AS seq, o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS original FROM orders
WHERE o_custkey NOT IN (FROM h) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
    "document_id_resolution": f"""SELECT {_FILE} AS path, CASE WHEN p_partkey % 10 = 0 THEN 'D' || p_partkey WHEN p_partkey % 3 = 0 AND p_partkey >= 100 THEN p_partkey::VARCHAR ELSE p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_partkey || ')' ELSE ' ' || p_partkey END END AS document_id,
CASE WHEN p_partkey % 10 = 0 THEN 'manifest' WHEN p_partkey % 3 = 0 AND p_partkey >= 100 THEN 'filename' ELSE 'stem' END AS document_id_source FROM part""",
    "header_aliases": """SELECT s_suppkey AS row_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['s. no.', 'ministry / organization', 'issue date', 'remark'] ELSE ['', 'ministry / organization', 'gazette id', 's. no.'] END) AS header,
unnest(CASE WHEN s_suppkey % 2 = 0 THEN [s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR, 'x'] ELSE [s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR, s_suppkey::VARCHAR] END) AS value FROM supplier""",
    "page_links": rf"""WITH {_LINKS} SELECT page_id, position, regexp_extract(a, '(?is)href=["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS label FROM l""",
    "listing_rows": """WITH r AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_custkey::VARCHAR END AS document_id, CASE o_orderkey % 4 WHEN 1 THEN (o_orderkey % 28 + 1) || '/7/2019' WHEN 2 THEN (o_orderkey % 28 + 1) || '/12/2020' ELSE '' END AS date FROM orders WHERE o_orderkey % 4 <> 0)
SELECT seq, document_id, date, CASE WHEN document_id = '' THEN 'no id' WHEN date = '' THEN 'no date' ELSE '' END AS reason FROM r""",
    "listing_gaps": rf"""WITH c AS (SELECT page_id, len(regexp_extract_all(html, '(?is)<a\s[^>]*href=["''][^"'']*["''][^>]*>.*?</a>')) AS parsed, page_id % 12 AS listed FROM pages)
SELECT page_id, parsed, listed, CASE WHEN abs(listed - parsed) > 5 THEN 'fail' WHEN listed <> parsed THEN 'warn' ELSE 'ok' END AS verdict FROM c""",
    "run_summary": "SELECT count_if(event_type = 'view') AS done, count_if(event_type = 'click') AS skipped, count_if(event_type = 'error') AS failed, sum(event_id % 30)::BIGINT AS pages FROM events",
    "file_names": rf"""WITH d AS (SELECT doc_id, doc_id % 28 + 1 AS d, doc_id % 12 + 1 AS m, 2000 + doc_id % 20 AS y, substring(text, 1, 10 + doc_id % 400) || ' | 1.5 MB' AS subject, source FROM documents),
c AS (SELECT *, printf('%04d-%02d-%02d', y, m, d) AS iso, {_SQ.format('subject')} AS sq FROM d),
s AS (SELECT *, {_COMP.format("trim(regexp_replace(sq, '(?i)\\s*\\|\\s*[0-9]+(?:\\.[0-9]+)?\\s*(?:KB|MB|GB)\\s*$', ''))")} AS s, {_COMP.format('sq')} AS stem FROM c)
SELECT doc_id, iso, md5(iso || ' - ' || {_CUT.format('s', '228', ' ')} || '.pdf') AS dated, md5(iso || ' - ' || source || ' - ' || {_CUT.format('s', "(245 - 10 - 3 - strlen(source) - 7)", ' ')} || '.pdf') AS typed,
  md5(CASE WHEN strlen(stem) <= 238 THEN stem ELSE {_CUT.format('stem', '224', ' .')} || '__' || left(sha1(subject), 12) END) AS stem FROM s""",
    "small_parsers": """WITH e AS (SELECT *, event_id % 33 AS d, event_id % 14 AS m FROM events)
SELECT event_id, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND day(last_day(make_date(2015, greatest(1, least(m, 12))::INT, 1))) THEN printf('2015-%02d-%02d', m, d) END AS day, printf('%02d/%02d/2015', d, m) AS masked,
  CASE event_id % 4 WHEN 0 THEN 'a ' || event_id || '.pdf' WHEN 1 THEN 'b ' || event_id || '.pdf' WHEN 2 THEN 'c' || event_id ELSE '' END AS attachment,
  CASE event_id % 5 WHEN 0 THEN '.doc' WHEN 1 THEN '.xls' WHEN 2 THEN '.zip' ELSE '.pdf' END AS ext, 9 AS rows_shown, event_id AS total, (event_id % 400) || 'A' AS section,
  regexp_matches(upper(event_type || ' ' || user_id), '429|500|502|503|504|RESOURCE_EXHAUSTED|UNAVAILABLE|DEADLINE_EXCEEDED|INTERNAL|HIGH DEMAND') AS transient,
  upper(event_type[1]) || event_type[2:] || ' Rule' AS label, CASE event_id % 4 WHEN 0 THEN 'bare_act' WHEN 2 THEN 'amendment' ELSE 'current_act' END AS kind,
  '/document?id=' || to_base64(encode(event_id::VARCHAR)) || '&category=' || event_type AS url, 5 + length(event_type) AS body FROM e""",
}
