"""Queries of readers: documents, parts and suppliers as provisions and related documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import reader as R
from codicil.sources.tables import spread, table


def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as terms, counted in documents."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("provision_id"), F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term")).filter("length(term) >= 6")
    glossary = w.groupBy("term").agg(F.min("provision_id").alias("provision_id"))
    return R.single_word_terms(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("provision_id"), "text"), glossary)


def term_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a few terms, one of two words."""
    return R.term_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("provision_id"), "text"), ["license", "the and", "tion", "public"])


def glossary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a glossary of any size, here all words and pairs of words of the benchmark."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("provision_id"), F.explode(F.concat(words, pairs)).alias("term"))
    glossary = w.groupBy("term").agg(F.min("provision_id").alias("provision_id")).withColumn("ord", -F.length("term"))  # the longer first
    return R.glossary_spans(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("provision_id"), "text")), glossary)


def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that texts mention."""
    t = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 40 AS string) AS section", "concat('see Section ', l_partkey % 60, 'a and section  ', l_orderkey % 30, ', subsection 4 of section 12(b); sectional 9') AS text")
    s = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN cast(p_size AS string) ELSE concat(p_size, 'A') END AS section")
    return R.cross_references(t, s)


def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendment Acts that notes cite, with pages."""
    n = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat('Inserted by Companies (Amendment) Act, ', 2014 + p_partkey % 8, ', item 3, PDF page ', p_size, '; omitted by the Companies Amendment Act ', 2015 + p_partkey % 3, CASE WHEN p_partkey % 2 = 0 THEN ', PDF page 7' ELSE '' END) AS note")
    return R.cited_sources(n, ["2015", "2017", "2019", "2020"]).select("id", "year", F.coalesce("page", F.lit("")).alias("page"))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated nodes over bundled text."""
    p = table(spark, sf_dir, "part").selectExpr("p_brand AS section", "concat('(', p_partkey, ')') AS label", "p_name AS text", "'active' AS status")
    n = table(spark, sf_dir, "lineitem").filter("l_partkey % 3 = 0").selectExpr("concat('Brand#', 10 + l_suppkey % 50) AS section", "concat('[', l_partkey, '.]') AS label", "CASE WHEN l_orderkey % 5 = 0 THEN concat('v', l_orderkey, '-', l_linenumber, '-', l_extendedprice) END AS verified_text", "CASE WHEN l_orderkey % 2 = 0 THEN concat('c', l_orderkey, '-', l_linenumber) END AS current_text", "CASE WHEN l_orderkey % 7 = 0 THEN 'omitted' END AS status", "l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey * 1000 + cast(l_quantity AS long) AS node_ord")
    return R.overlay(p, n)


def current_and_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and historical entries side by side."""
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 200 AS string) AS section", "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat('(', o_orderkey % 7, ')') ELSE concat(o_orderkey % 7, '.') END AS label", "o_orderpriority AS text", "o_orderkey AS ord")
    return R.current_and_history(o.filter("ord % 3 <> 0"), o.filter("ord % 3 = 0"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS provision_id", "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_partkey END AS document_id", "l_orderkey * 10 + l_linenumber AS relationship_id", "l_linenumber AS sort_order",
        "CASE l_partkey % 5 WHEN 0 THEN 'rule' WHEN 1 THEN 'notification' WHEN 2 THEN 'rules_and_forms' WHEN 3 THEN 'act' ELSE 'circular' END AS instrument_type",
    )


def distinct_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First edge of each document of a provision."""
    return R.distinct_relationships(_edges(spark, sf_dir)).groupBy("provision_id", "sort_order").agg(F.count("*").alias("n"))


def surplus_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus edges per provision."""
    return R.surplus_relationships(_edges(spark, sf_dir))


def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab counts of provisions."""
    c = table(spark, sf_dir, "orders").selectExpr("o_custkey AS provision_id", "CASE o_orderkey % 3 WHEN 0 THEN 'amendment' WHEN 1 THEN 'bulb' ELSE 'note' END AS callout_type")
    return R.tab_counts(_edges(spark, sf_dir), c)


def refreshed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshed lists in their old order, new entries last."""
    o = table(spark, sf_dir, "orders")
    shown = o.filter("o_orderkey % 3 <> 0").selectExpr("o_custkey AS group", "o_orderkey AS id", "-o_orderkey AS ord")
    return R.refreshed_order(shown, o.filter("o_orderkey % 5 <> 0").selectExpr("o_custkey AS group", "o_orderkey AS id", "o_orderkey AS ord"), "id").drop("ord")


def family_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last other document of a family."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "concat(source, ' ', lang, ' Rules ', 2000 + doc_id % 20) AS title", "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat(2000 + doc_id % 20, '-01-', lpad(doc_id % 28 + 1, 2, '0')) END AS date", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'x' END AS text")
    return R.family_predecessor(d).select("id", "family", F.coalesce("predecessor_id", F.lit(-1)).alias("predecessor_id"))


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows valid on a day, and live revisions of it."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS effective_from", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderdate AS date) + 400 END AS effective_to", "o_orderstatus AS field_name", "cast(date_trunc('MONTH', o_orderdate) AS date) AS effective_date", "CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS undone_by_revision_id", "CASE WHEN o_orderkey % 7 = 0 THEN 1 END AS reverts_revision_id")
    day = F.lit("1996-01-01").cast("date")
    live = R.live_revisions(o, "F", day).select("id").withColumn("live", F.lit(True))
    return R.valid_on(o, day).select("id").join(live, "id", "left").select("id", F.coalesce("live", F.lit(False)).alias("live"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of a hundred provisions, some without a first or last day."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 100 AS provision_id", "CASE WHEN o_orderkey % 40 <> 0 THEN cast(o_orderdate AS date) END AS effective_from", "CASE WHEN o_orderkey % 30 <> 0 THEN date_add(cast(o_orderdate AS date), cast(o_custkey % 90 AS int) - 5) END AS effective_to")


def validity_on_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 for many days: which versions of a provision are valid on the days that lines ship."""
    days = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 100 AS provision_id", "cast(l_shipdate AS date) AS day").distinct()
    pairs = R.valid_on_days(_versions(spark, sf_dir), days, "day", ["provision_id"])
    return pairs.groupBy("provision_id", "day").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 for many days: how many of all versions are valid on each day that lines ship."""
    days = table(spark, sf_dir, "lineitem").selectExpr("cast(l_shipdate AS date) AS day").distinct()
    return R.valid_counts(_versions(spark, sf_dir), days, "day", [])


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(o_custkey % 90 AS string) AS section", "o_orderpriority AS label", "to_json(named_struct('status', o_orderstatus)) AS old_value", "to_json(named_struct('priority', o_orderpriority)) AS new_value", "CASE o_orderkey % 3 WHEN 0 THEN 'callout_title' WHEN 1 THEN 'callout_text' ELSE 'text' END AS field_name")


def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revisions and messages by substring."""
    r = revisions(spark, sf_dir)
    hits = R.change_history(r, "1-urgent", "callout_*")
    box = R.inbox(table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS sender_name", "c_mktsegment AS message"), "BUILD")
    return hits.select("id", "section", F.lit("revision").alias("kind")).unionByName(box.select("id", F.lit("").alias("section"), F.lit("message").alias("kind")))


def evidence_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of JSON properties."""
    return R.evidence_leaves(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "label", "value_text")


def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal labels in order within groups of one kind or several."""
    romans = "array('i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv')"
    d = table(spark, sf_dir, "orders").selectExpr("o_custkey AS grp", "o_orderkey AS id", f"CASE o_custkey % 3 WHEN 0 THEN concat('(', o_orderkey % 120, ')') WHEN 1 THEN concat('(', element_at({romans}, cast(o_orderkey % 14 AS int) + 1), ')') ELSE concat(o_orderkey % 30, substr('ABC', cast(o_orderkey % 3 AS int) + 1, 1)) END AS label")
    return R.ordered_labels(d.dropDuplicates(["grp", "label"]).select("grp", "label"), "grp", "label")


def clause_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: clauses by verified lines."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.selectExpr("cast(l_orderkey AS string) AS section", "cast(rint(l_extendedprice * 100) AS long) * 10 + l_linenumber AS line", "CASE WHEN l_linenumber <= 2 THEN concat('(', l_linenumber, ')') ELSE concat('(', substr('abcdefgh', l_linenumber, 1), ')') END AS label")
    clauses = li.filter("l_linenumber > 2").selectExpr("cast(l_orderkey AS string) AS section", "concat('(', l_partkey % 2 + 1, ')') AS subsection", "concat('(', substr('abcdefgh', l_linenumber, 1), ')') AS clause", "l_linenumber AS ord").groupBy("section", "subsection", "clause").agg(F.min("ord").alias("ord"))
    return R.verified_clause_order(clauses, lines)


def library_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of the library's order."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS updated_at")
    return R.library_order(o).limit(50)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes anchored at the nearest boundary, in order of their offsets."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "cast(doc_id * 37 % (length(text) + 1) AS int) AS raw")
    return d.select("doc_id", R.snapped_anchor(F.col("text"), F.col("raw")).alias("a")).select("doc_id", "a.offset", "a.kind", F.md5("a.quote").alias("quote"))


def near_copy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word differences of documents with an altered copy."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.regexp_replace("text", "(?m)^([A-Z][a-z]+) ", "$1, indeed, ").alias("new"))
    diff = R.word_diff(d, "text", "new")
    of = lambda *kinds: F.md5(F.array_join(F.transform(F.filter("diff", lambda x: x["type"].isin(*kinds)), lambda x: x["value"]), ""))
    return diff.select("doc_id", F.size("diff").alias("n_runs"), (of("same", "removed") == F.md5(F.coalesce("text", F.lit("")))).alias("old_whole"), (of("same", "added") == F.md5(F.coalesce("new", F.lit("")))).alias("new_whole"))


_FNS = (glossary_terms, term_spans, glossary_spans, cross_references, cited_sources, overlay, current_and_history, distinct_relationships, surplus_relationships, tab_counts, refreshed_order, family_predecessor, validity, validity_on_days, validity_counts, change_history, evidence_leaves, label_order, clause_line_order, library_order, anchors, near_copy_diff)
QUERIES = {f.__name__: f for f in _FNS}

_ID = r"regexp_replace(lower({}), '[()\[\].\s]', '', 'g')"
_EDGES = """e AS (SELECT l_suppkey AS provision_id, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_partkey END AS document_id, l_orderkey * 10 + l_linenumber AS relationship_id, l_linenumber AS sort_order,
  CASE l_partkey % 5 WHEN 0 THEN 'rule' WHEN 1 THEN 'notification' WHEN 2 THEN 'rules_and_forms' WHEN 3 THEN 'act' ELSE 'circular' END AS instrument_type FROM lineitem),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY provision_id, document_id ORDER BY sort_order, relationship_id) = 1)"""

_VERSIONS = """v AS (SELECT o_orderkey AS id, o_custkey % 100 AS provision_id, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate::DATE ELSE DATE '0001-01-01' END AS a,
  CASE WHEN o_orderkey % 30 <> 0 THEN o_orderdate::DATE + (o_custkey % 90 - 5)::INT ELSE DATE '9999-12-31' END AS b FROM orders)"""

ORACLE_SQL = {
    "glossary_terms": """WITH t AS (SELECT term, min(item_id) AS own FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark) WHERE length(term) >= 6 AND term NOT IN ('act', 'company') GROUP BY term),
c AS (SELECT doc_id AS provision_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) GROUP BY ALL) SELECT provision_id, term, n FROM c JOIN t ON word = term WHERE own <> provision_id""",
    "cross_references": r"""WITH t AS (SELECT (l_suppkey % 40)::VARCHAR AS from_section, unnest([(l_partkey % 60) || 'A', (l_orderkey % 30)::VARCHAR, '12']) AS to_section FROM lineitem),
s AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_size || 'A' END AS s FROM part) SELECT from_section, to_section, count(*) AS n, to_section IN (FROM s) AS resolved FROM t GROUP BY from_section, to_section""",
    "cited_sources": """WITH n AS (SELECT p_partkey AS id, 2014 + p_partkey % 8 AS y1, 2015 + p_partkey % 3 AS y2, p_size, p_partkey % 2 = 0 AS even FROM part), y AS (SELECT unnest([2015, 2017, 2019, 2020]) AS year)
SELECT id, year::VARCHAR AS year, CASE WHEN y1 = year THEN p_size::VARCHAR WHEN even THEN '7' ELSE '' END AS page FROM n, y WHERE year IN (y1, y2)""",
    "overlay": f"""WITH n AS (SELECT 'Brand#' || (10 + l_suppkey % 50) AS section, l_partkey::VARCHAR AS l, arg_max({{'v': CASE WHEN l_orderkey % 5 = 0 THEN 'v' || l_orderkey || '-' || l_linenumber || '-' || l_extendedprice END, 'c': CASE WHEN l_orderkey % 2 = 0 THEN 'c' || l_orderkey || '-' || l_linenumber END, 's': CASE WHEN l_orderkey % 7 = 0 THEN 'omitted' END}}, l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey * 1000 + l_quantity::BIGINT) AS n FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY ALL)
SELECT p_brand AS section, '(' || p_partkey || ')' AS label, coalesce(n.v, n.c, p_name) AS text, coalesce(n.s, 'active') AS status FROM part LEFT JOIN n ON section = p_brand AND l = p_partkey::VARCHAR""",
    "current_and_history": f"""WITH o AS (SELECT (o_custkey % 200)::VARCHAR AS section, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN '(' || o_orderkey % 7 || ')' ELSE (o_orderkey % 7) || '.' END AS label, o_orderpriority AS text, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS kind FROM orders),
k AS (SELECT *, coalesce(nullif({_ID.format('label')}, ''), label, 'unknown-' || kind || '-' || ord) AS identifier FROM o),
g AS (SELECT section, identifier, coalesce(string_agg(text, ' | ' ORDER BY ord) FILTER (kind = 0), '') AS current, coalesce(string_agg(text, ' | ' ORDER BY ord) FILTER (kind = 1), '') AS historical, min({{'k': kind, 'o': ord}}) AS f FROM k GROUP BY ALL)
SELECT section, identifier, current, historical, row_number() OVER (PARTITION BY section ORDER BY f) AS position FROM g""",
    "distinct_relationships": f"WITH {_EDGES} SELECT provision_id, sort_order, count(*) AS n FROM d GROUP BY ALL",
    "surplus_relationships": f"WITH {_EDGES} SELECT e.provision_id, e.n - d.n AS removed FROM (SELECT provision_id, count(*) AS n FROM e GROUP BY ALL) e JOIN (SELECT provision_id, count(*) AS n FROM d GROUP BY ALL) d USING (provision_id) WHERE e.n > d.n",
    "tab_counts": f"""WITH {_EDGES}, a AS (SELECT provision_id, count_if(contains(instrument_type, 'rule')) AS rules, count_if(regexp_matches(instrument_type, 'form|notification|order|circular')) AS notifications FROM d GROUP BY ALL),
c AS (SELECT o_custkey AS provision_id, count_if(o_orderkey % 3 = 2) AS callouts, count_if(o_orderkey % 3 = 0) AS amendments, count_if(o_orderkey % 3 = 1) AS bulbs FROM orders GROUP BY ALL)
SELECT provision_id, coalesce(rules, 0) AS rules, coalesce(notifications, 0) AS notifications, coalesce(callouts, 0) AS callouts, coalesce(amendments, 0) AS amendments, coalesce(bulbs, 0) AS bulbs FROM a FULL JOIN c USING (provision_id)""",
    "refreshed_order": """SELECT o_custkey AS "group", o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -o_orderkey END) AS position FROM orders WHERE o_orderkey % 5 <> 0""",
    "family_predecessor": """WITH d AS (SELECT doc_id AS id, source || lang AS family, CASE WHEN doc_id % 6 = 0 THEN '' ELSE printf('%d-01-%02d', 2000 + doc_id % 20, doc_id % 28 + 1) END AS day, doc_id % 4 <> 0 AS has FROM documents),
r AS (SELECT family, id, row_number() OVER (PARTITION BY family ORDER BY day DESC, id DESC) AS n FROM d WHERE has)
SELECT d.id, d.family, coalesce(CASE WHEN a.id <> d.id THEN a.id ELSE b.id END, -1) AS predecessor_id FROM d LEFT JOIN r a ON a.family = d.family AND a.n = 1 LEFT JOIN r b ON b.family = d.family AND b.n = 2""",
    "validity": """SELECT o_orderkey AS id, o_orderstatus = 'F' AND date_trunc('month', o_orderdate) = DATE '1996-01-01' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS live FROM orders
WHERE (o_orderkey % 4 = 0 OR o_orderdate::DATE <= DATE '1996-01-01') AND (o_orderkey % 3 = 0 OR o_orderdate::DATE + 400 >= DATE '1996-01-01')""",
    "validity_on_days": f"""WITH {_VERSIONS}, d AS (SELECT DISTINCT l_suppkey % 100 AS provision_id, l_shipdate::DATE AS day FROM lineitem)
SELECT d.provision_id, day, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM d JOIN v ON v.provision_id = d.provision_id AND day BETWEEN a AND b GROUP BY ALL""",
    "validity_counts": f"WITH {_VERSIONS}, d AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem) SELECT day, count(id) AS n FROM d LEFT JOIN v ON day BETWEEN a AND b GROUP BY day",
    "change_history": """SELECT o_orderkey AS id, (o_custkey % 90)::VARCHAR AS section, 'revision' AS kind FROM orders WHERE o_orderkey % 3 < 2 AND contains(lower(o_orderpriority), '1-urgent')
UNION ALL SELECT c_custkey, '', 'message' FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')""",
    "evidence_leaves": """SELECT event_id, replace(k, '_', ' ') AS label, json_extract_string(props, '$.' || k) AS value_text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE coalesce(json_extract_string(props, '$.' || k), '') <> ''""",
    "label_order": """WITH r AS (SELECT ['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv'] AS r),
d AS (SELECT DISTINCT o_custkey AS grp, CASE o_custkey % 3 WHEN 0 THEN '(' || o_orderkey % 120 || ')' WHEN 1 THEN '(' || r[o_orderkey % 14 + 1] || ')' ELSE (o_orderkey % 30) || substr('ABC', (o_orderkey % 3 + 1)::INT, 1) END AS label,
  CASE o_custkey % 3 WHEN 0 THEN o_orderkey % 120 WHEN 1 THEN o_orderkey % 14 ELSE o_orderkey % 30 END AS k FROM orders, r)
SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY k, label) AS position FROM d""",
    "clause_line_order": """WITH li AS (SELECT *, l_orderkey::VARCHAR AS section, (l_extendedprice * 100)::BIGINT * 10 + l_linenumber AS line FROM lineitem),
c AS (SELECT section, '(' || l_partkey % 2 + 1 || ')' AS subsection, '(' || substr('abcdefgh', l_linenumber, 1) || ')' AS clause, min(l_linenumber) AS ord FROM li WHERE l_linenumber > 2 GROUP BY ALL),
s AS (SELECT c.section, subsection, min(line) AS a FROM (SELECT DISTINCT section, subsection FROM c) c JOIN li ON li.section = c.section AND l_linenumber <= 2 AND subsection = '(' || l_linenumber || ')' GROUP BY ALL),
t AS (SELECT *, lead(a) OVER (PARTITION BY section ORDER BY a) AS b FROM s),
h AS (SELECT c.section, c.subsection, c.clause, min(li.line) AS line FROM c JOIN t USING (section, subsection) JOIN li ON li.section = c.section AND l_linenumber = c.ord AND li.line > a AND (b IS NULL OR li.line < b) GROUP BY ALL)
SELECT c.*, row_number() OVER (PARTITION BY section, subsection ORDER BY coalesce(line, 2147483647), ord) AS position FROM c LEFT JOIN h USING (section, subsection, clause)""".replace("'(' || l_partkey % 2 + 1 || ')'", "'(' || (l_partkey % 2 + 1) || ')'"),
    "library_order": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at FROM orders ORDER BY coalesce(updated_at, '') DESC, o_orderkey::VARCHAR DESC LIMIT 50",
}
