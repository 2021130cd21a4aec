"""Queries on documents as a corpus, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions import text as X
from codicil.operators import corpus as C
from codicil.operators import extract as T
from codicil.plans.sql import STRIP, PAGES_SQL, ROUTED_SQL
from codicil.sources.shared import shared_path
from codicil.sources.tables import spread, table


def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by language and verdict."""
    pages = C.route_pages(C.split_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))))
    return pages.groupBy("lang", "reason").agg(F.count("*").alias("n_pages"), F.sum("latin_characters").alias("latin"), F.sum("english_words").alias("words"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts per document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.latin_characters(t).alias("latin"), X.english_words(t).alias("words"), F.length("text").alias("chars"), X.is_placeholder(t).alias("placeholder")
    )


def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rolled up to documents."""
    pages = C.route_pages(C.split_pages(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return C.roll_up(pages, "doc_id").withColumn("full_text", F.md5("full_text"))


def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain-text report of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    header = F.concat(F.lit("Document: "), F.col("doc_id").cast("string"), F.lit("\nSource: "), F.col("source"))
    return C.text_report(C.route_pages(C.split_pages(docs)), "doc_id", header).select("doc_id", F.md5("report").alias("report_md5"), F.length("report").alias("chars"))


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and state of conversion, with totals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    outputs = docs.filter("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("json"), F.lit("txt"))).alias("kind"))
    outputs = outputs.unionByName(docs.filter("doc_id % 3 = 1").select("doc_id", F.lit("json").alias("kind")))
    state = C.conversion_state(docs, outputs, docs.filter("doc_id % 6 = 1").select("doc_id"), "doc_id")
    counted = state.rollup("source", "state").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce("source", F.lit("(all)")).alias("source"), F.coalesce("state", F.lit("(all)")).alias("state"), "n")


def layout_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts."""
    t = F.col("text")
    made = {"squeezed": X.squeeze(t), "layout": X.clean_layout(t), "sanitized": X.sanitize(t), "english": X.english_lines(t), "unmarked": X.without_markup(F.concat(F.lit("[[bold]]"), t, F.lit("[[/bold]]")))}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(c).alias(n) for n, c in made.items()])


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison, family and identifier keys of first lines."""
    first = F.split("text", "\n")[0]
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.comparison_key(F.col("text")).alias("key_text"), X.family_key(F.concat(F.lit("Order 2015 "), first)).alias("family"), X.identifier(F.concat(F.lit("("), F.col("source"), F.lit(") [a].1"))).alias("ident")
    ).withColumn("key_text", F.md5("key_text"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of keys and SHA-256 of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", X.fnv1a(X.comparison_key(F.col("text"))).alias("fnv"), F.sha2("text", 256).alias("sha256"))


def corpus_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus text without boilerplate."""
    docs = C.normalized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    with_furniture = F.concat(F.lit("EXTRAORDINARY\nPUBLISHED BY AUTHORITY\n"), F.col("text"), F.lit("\nHkkjr  text , end\n12 GI/2015 (3)"))
    return docs.select("doc_id", F.md5(X.boilerplate_free(with_furniture)).alias("cleaned"))


def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping page batches of documents of n_chars / 500 pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).cast("int").alias("n_pages"))
    return C.page_batches(docs, "n_pages")


def page_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpointed pages and the rest, together all pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).cast("int").alias("total"))
    every = docs.filter("total > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "total")).alias("page"))
    done = every.filter("(doc_id + page) % 3 = 0")
    rest = every.join(done, ["doc_id", "page"], "left_anti").filter("doc_id % 10 <> 7")
    counts = rest.groupBy("doc_id").agg(F.count("*").alias("resumed"))
    checked = C.all_pages_present(done.unionByName(rest), docs, "doc_id")
    return checked.join(counts, "doc_id", "left").select("doc_id", "found", "total", "complete", F.coalesce("resumed", F.lit(0)).alias("resumed"))


def _counting(texts: list[str], carry: str | None) -> tuple[str, str]:
    """An offline stand-in for a model: characters of a batch after the length of the last page of the batch before."""
    return f"{carry or ''}|{sum(map(len, texts))}", str(len(texts[-1]))


def _faltering(texts: list[str], carry: str | None) -> tuple[str, str]:
    body, carry = _counting(texts, carry)
    if len(body) % 4 == 0:
        raise ConnectionError("no answer")
    return body, carry


def extracted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, J8 and a caller's extractor: a first run with failures, then one that does what is left."""
    path = shared_path(spark, "extracted")
    pages = C.split_pages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    batches = C.page_batches(pages.groupBy("doc_id").agg(F.max("page").alias("n")), "n", 3, 1)
    T.extract_to(pages, batches, _faltering, path, attempts=1)
    return T.extract_to(pages, batches, _counting, path).select("doc_id", "key", "start", "body")


QUERIES = {f.__name__: f for f in (page_routing, text_statistics, document_rollup, document_report, state_counts, layout_cleanup, text_keys, content_hashes, corpus_boilerplate, page_batches, page_completeness, extracted_batches)}

ORACLE_SQL = {
    "extracted_batches": f"""WITH {PAGES_SQL}, n AS (SELECT doc_id, max(page) AS n FROM pages GROUP BY doc_id), b AS (SELECT doc_id, n, unnest(range(1, greatest(n - 1, 1) + 1, 2)) AS start FROM n),
s AS (SELECT b.doc_id, start, least(start + 2, n) AS e, sum(length(text)) AS total, max(CASE WHEN page = least(start + 2, n) THEN length(text) END) AS last FROM b JOIN pages p ON p.doc_id = b.doc_id AND page BETWEEN start AND start + 2 GROUP BY ALL)
SELECT doc_id, printf('pages-%04d-%04d', start, e) AS key, start::INT AS start, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY start)::VARCHAR, '') || '|' || total AS body FROM s""",
    "page_routing": f"WITH {ROUTED_SQL} SELECT lang, reason, count(*) AS n_pages, sum(latin)::BIGINT AS latin, sum(words)::BIGINT AS words FROM routed GROUP BY ALL",
    "text_statistics": rf"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin,
  len(regexp_extract_all(regexp_replace(text, '[\x{{00C0}}-\x{{00D6}}\x{{00D8}}-\x{{00F6}}\x{{00F8}}-\x{{024F}}]', '_', 'g'), '\b[A-Za-z][A-Za-z0-9''’.\-]*\b')) AS words,
  length(text) AS chars, (contains(lower(text), 'please wait...')::INT + contains(lower(text), 'please wait')::INT) >= 2 AS placeholder FROM documents""",
    "document_rollup": f"""WITH {ROUTED_SQL} SELECT doc_id, count(*) AS total_pages, count_if(reason = 'good') AS native_pages, count_if(reason <> 'good') AS fallback_pages,
  count_if(reason = 'empty') AS empty_pages, count_if(reason = 'empty') > 0 AS requires_review,
  md5(coalesce(string_agg(english, chr(10) || chr(10) ORDER BY page) FILTER (trim(english) <> ''), '')) AS full_text FROM routed GROUP BY doc_id""",
    "document_report": f"""WITH {ROUTED_SQL}, r AS (SELECT doc_id, 'Document: ' || doc_id || chr(10) || 'Source: ' || any_value(source) || chr(10) || string_agg(
  repeat('=', 40) || chr(10) || 'PAGE ' || page || ' [' || CASE WHEN reason = 'good' THEN 'native_text' ELSE 'fallback' END || ']' || chr(10) || repeat('=', 40) || chr(10)
  || CASE WHEN trim(english) = '' THEN '[NO ENGLISH TEXT]' ELSE english END, chr(10) ORDER BY page) AS report FROM routed GROUP BY doc_id)
SELECT doc_id, md5(report) AS report_md5, length(report) AS chars FROM r""",
    "state_counts": """
SELECT coalesce(source, '(all)') AS source, coalesce(state, '(all)') AS state, count(*) AS n FROM (
  SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'complete' WHEN doc_id % 6 = 1 THEN 'partial' ELSE 'pending' END AS state FROM documents) GROUP BY ROLLUP (source, state)""",
    "layout_cleanup": rf"""
WITH t AS (SELECT doc_id, text, regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g') AS plain FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\b[0-9]+\*+', '', 'g'), '[0-9]+\[', '[', 'g'), chr(10)), lambda x: {STRIP.format('x')}),
  lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '(?i)^[0-9]+\s+SECTIONS$')) AS kept FROM t)
SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{{00A0}}]+', ' ', 'g'))) AS squeezed,
  md5(trim(regexp_replace(regexp_replace(plain, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS layout,
  md5(trim(regexp_replace(regexp_replace(array_to_string(kept, ' '), '([\p{{L}}\p{{N}}_]+)-\s+([\p{{L}}\p{{N}}_]+)', '\1\2', 'g'), '\s+', ' ', 'g'))) AS sanitized,
  md5(array_to_string(list_filter(list_transform(string_split(plain, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-z]') OR regexp_matches(x, '^([(\[{{]?[0-9]+[A-Za-z]?[)\]}}]?[.:-]?|[(\[][ivxlcdmIVXLCDM]+[)\]]|[-–—]+)$')), chr(10))) AS english,
  md5(text) AS unmarked FROM t JOIN s USING (doc_id)""",
    "text_keys": r"""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key_text,
  regexp_replace(regexp_replace(regexp_replace(lower('Order 2015 ' || string_split(text, chr(10))[1]), '[\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]', '_', 'g'), '\b(amendment|notification|order|rules?|regulations?|[0-9]{4})\b', '', 'g'), '[^a-z0-9]+', '', 'g') AS family,
  regexp_replace(lower('(' || source || ') [a].1'), '[()\[\].\s]', '', 'g') AS ident FROM documents""",
    "content_hashes": r"""
SELECT doc_id, lower(printf('%X', list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split(k, ''), lambda x: x <> ''), lambda x: ord(x)::BIGINT)),
  lambda h, x: ((xor(h, x) * 16777619) & 4294967295)::BIGINT))) AS fnv, sha256(text) AS sha256
FROM (SELECT doc_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents)""",
    "page_batches": """
WITH d AS (SELECT doc_id, ceil(n_chars / 500)::INT AS n_pages FROM documents), b AS (SELECT doc_id, n_pages, unnest(range(1, greatest(n_pages - 2, 1) + 1, 18))::INT AS start FROM d WHERE n_pages > 0)
SELECT doc_id, n_pages, ((start - 1) // 18)::INT AS batch, start, least(start + 19, n_pages) AS "end", printf('pages-%04d-%04d', start, least(start + 19, n_pages)) AS key FROM b""",
    "page_completeness": """
WITH d AS (SELECT doc_id, ceil(n_chars / 500)::INT AS total FROM documents), e AS (SELECT doc_id, unnest(range(1, total + 1)) AS page FROM d)
SELECT doc_id, count(page) FILTER ((doc_id + page) % 3 = 0 OR doc_id % 10 <> 7) AS found, any_value(total) AS total,
  count(page) FILTER ((doc_id + page) % 3 = 0 OR doc_id % 10 <> 7) = any_value(total) AS complete, count(page) FILTER ((doc_id + page) % 3 <> 0 AND doc_id % 10 <> 7) AS resumed
FROM d LEFT JOIN e USING (doc_id) GROUP BY doc_id""",
}
