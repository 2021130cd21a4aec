"""Queries on events, scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import manifest as M
from codicil.operators import statute as S
from codicil.plans.statute_queries import fragments
from codicil.sources import files as I
from codicil.sources import manifests as P
from codicil.sources.shared import shared_path
from codicil.sources.tables import table
from codicil.streaming import events as E


def active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active seconds per user."""
    return E.active_time(table(spark, sf_dir, "events"))


def streamed_active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 as a stream, tick by tick, stopped and started again in between: the earlier half of the events, the later one,
    and an event of nobody a day later, which moves the watermark past all others."""
    path = shared_path(spark, "active-time")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    half, last = events.agg(F.percentile_approx("ts", 0.5).alias("half"), F.max("ts").alias("last")).first()
    if half is None:
        return spark.createDataFrame([], "user_id long, active_seconds long")
    closing = events.limit(1).withColumn("ts", (F.lit(last) + F.expr("INTERVAL 1 DAY")).cast(events.schema["ts"].dataType)).withColumn("user_id", F.lit(None).cast("long"))
    for part in (events.filter(F.col("ts") <= half), events.filter(F.col("ts") > half), closing):
        part.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("user_id", F.coalesce("user_id", F.lit(-1))).write.mode("append").parquet(f"{path}/events")
        ticks = E.active_ticks(E.event_stream(spark, f"{path}/events", 10**6))
        E.append_all(ticks, f"{path}/ticks", f"{path}/checkpoint")
    ticks = spark.read.schema("user_id long, tick long, active_seconds long").parquet(f"{path}/ticks").filter("user_id >= 0")
    return ticks.groupBy("user_id").agg(F.max("active_seconds").alias("active_seconds"))


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of activity."""
    s = E.active_sessions(table(spark, sf_dir, "events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("largest"))


def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    return E.usage(table(spark, sf_dir, "events"))


def search_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel per day."""
    return E.funnel(table(spark, sf_dir, "events"))


def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their reader's attributes, counted."""
    readers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return E.enriched(table(spark, sf_dir, "events"), readers).groupBy("platform", "c_mktsegment").agg(F.count("*").alias("n"))


def unread_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: unread messages by kind."""
    return E.backlog(table(spark, sf_dir, "events").selectExpr("event_type AS kind", "CASE WHEN event_id % 3 = 0 THEN ts END AS read_at"))


def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 as a stream over the event files."""
    return E.run_to_table(E.usage(E.event_stream(spark, f"{sf_dir}/events*.parquet")), "usage")


def streamed_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 as a stream over the event files."""
    stream = E.event_stream(spark, f"{sf_dir}/events*.parquet").selectExpr("event_type AS kind", "CASE WHEN event_id % 3 = 0 THEN ts END AS read_at")
    return E.run_to_table(E.backlog(stream), "backlog")


def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest kept by a restartable stream."""
    path = shared_path(spark, "ingest")
    rows = E.once(E.event_stream(spark, f"{sf_dir}/events*.parquet"), "30 days").selectExpr("event_id AS seq", "cast(user_id AS string) AS document_id", "event_type AS particulars", "event_type AS status")
    last_of_each = lambda d: M.upsert(d, ["particulars"])
    last = E.ingest(rows, last_of_each, f"{path}/table", f"{path}/checkpoint")
    if last is None:
        return spark.createDataFrame([], rows.schema)
    return E.ingested(spark, rows.schema, last_of_each, f"{path}/table", last)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes written by kind and read again."""
    path = shared_path(spark, "envelopes")
    d = table(spark, sf_dir, "documents").selectExpr("concat(doc_id, CASE doc_id % 4 WHEN 0 THEN '_Bare_Current' WHEN 1 THEN '_original' WHEN 2 THEN '_Ordinance' ELSE '' END, '.json') AS filename", "'offline' AS model", "named_struct('title', source, 'n', n_chars) AS parsed")
    I.write_envelopes(d, path)
    good, _ = I.read_envelopes(spark, path, "struct<title:string,n:bigint>")
    refused = I.not_allowed(good, ["0_Bare_Current.json", "1_original.json"])
    return refused.groupBy("kind").agg(F.count("*").alias("n"), F.sum("parsed.n").alias("chars"), F.count_distinct("sha256").alias("versions"))


def fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: a source of documents is published if all of it is valid, else nothing of it is."""
    path = shared_path(spark, "fail-closed")
    d = table(spark, sf_dir, "documents").selectExpr("source", "concat(doc_id, '.json') AS filename", "'offline' AS model", "named_struct('title', source, 'n', n_chars) AS parsed", "CASE WHEN n_chars < 20 THEN 'too short' END AS problem")
    I.publish_valid(d, path, "source", F.col("problem"))
    good, verdicts = I.published(spark, path, "struct<title:string,n:bigint>")
    sources = d.groupBy("source").agg(F.md5("source").alias("hash")).select("source", F.coalesce(F.concat(F.lit("k"), "hash"), F.lit("null")).alias("key"))
    written = good.groupBy(F.col("group").alias("source")).agg(F.count("*").alias("written"))
    judged = sources.join(verdicts, "key").select("source", "refused")
    return judged.join(written, judged["source"].eqNullSafe(written["source"]), "left").select(judged["source"], F.coalesce("written", F.lit(0)).alias("written"), "refused")


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of several headers in several folders; a document is a resolved path, and the later row wins."""
    path = shared_path(spark, "manifests")
    events = table(spark, sf_dir, "events").withColumn("id", F.expr("CASE WHEN event_id % 6 <> 0 THEN cast(event_id AS string) ELSE '' END"))
    file = "concat(CASE WHEN event_id % 5 = 0 THEN '../event_type=view/./' ELSE '' END, 'f', user_id, '.pdf')"
    shapes = (
        ("a", ["id AS document_id", f"{file} AS saved_filename", "'downloaded' AS status"]),
        ("b", [f"{file} AS saved_filename", "concat('on \"', user_id, '\",\n', event_id) AS particulars", "id AS document_id"]),
        ("c", ["1 AS result_page", f"{file} AS filename", "event_type AS link_text", "'u' AS url", "9 AS bytes", "'ok' AS status"]),
    )
    for k, (folder, columns) in enumerate(shapes):  # files in the order of event_id, as the later manifest wins
        rows = events.filter(F.col("event_id") % 3 == k).repartitionByRange("event_id").sortWithinPartitions("event_type", "event_id")
        rows.selectExpr("event_type", *columns).write.partitionBy("event_type").options(header=True, escape='"').csv(f"{path}/{folder}")
    found = P.latest_ids(P.scan_manifests(spark, path, "*.csv"))
    return found.select(F.regexp_extract("filename", "([ab]/event_type=[^/]*/[^/]*)$", 1).alias("filename"), "document_id")


def nested_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged act as nested arrays, one row per chapter, written to two places and read from the second."""
    path = shared_path(spark, "nested-master")
    I.write_nested_master(S.merge_clauses(fragments(spark, sf_dir)), [f"{path}/master", f"{path}/copy"])
    chapters = spark.read.schema("chapter string, sections array<struct<section string, subsections array<struct<subsection string, clauses array<struct<clause string, text string>>>>>>").json(f"{path}/copy")
    return chapters.select("chapter", F.size("sections").alias("n_sections"), F.to_json("sections").alias("sections"))


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the documents table, scanned and fingerprinted."""
    return I.fingerprints(I.scan_corpus(spark, sf_dir, "*.parquet", "documents"))


_FNS = (active_time, streamed_active_time, active_sessions, usage_counts, search_funnel, enriched_events, unread_backlog, streamed_usage, streamed_backlog, streamed_ingest, envelopes, fail_closed, manifest_scan, nested_master, table_files)
QUERIES = {f.__name__: f for f in _FNS}

_USAGE = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, count(value) AS n_values FROM events GROUP BY ALL"
_BACKLOG = "SELECT event_type AS kind, count_if(event_id % 3 <> 0) AS unread FROM events GROUP BY ALL"
_ACTIVE = "SELECT user_id, ((sum(least(coalesce(g, 1000000000000), 30000000)) // 10000000) * 10)::BIGINT AS active_seconds FROM (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS g FROM events) GROUP BY user_id"
ORACLE_SQL = {
    "active_time": _ACTIVE,
    "streamed_active_time": _ACTIVE,
    "active_sessions": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 30000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS largest FROM c GROUP BY user_id""",
    "usage_counts": _USAGE,
    "search_funnel": """WITH u AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) FILTER (event_type = 'click') AS a, max(ts) FILTER (event_type = 'view') AS b, max(ts) FILTER (event_type = 'purchase') AS c FROM events GROUP BY ALL)
SELECT day, count(a) AS submitted, count(*) FILTER (b > a) AS completed, count(*) FILTER (b > a AND c > a) AS selected FROM u GROUP BY day""",
    "enriched_events": "SELECT 'web' AS platform, c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL",
    "unread_backlog": _BACKLOG,
    "streamed_usage": _USAGE,
    "streamed_backlog": _BACKLOG,
    "streamed_ingest": "SELECT max(event_id) AS seq, user_id::VARCHAR AS document_id, arg_max(event_type, event_id) AS particulars, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id",
    "envelopes": """SELECT CASE doc_id % 4 WHEN 1 THEN 'bare_act' WHEN 2 THEN 'amendment' ELSE 'current_act' END AS kind, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT source || ' ' || n_chars) AS versions FROM documents WHERE doc_id > 1 GROUP BY ALL""",
    "fail_closed": "SELECT source, CASE WHEN count_if(n_chars < 20) = 0 THEN count(*) ELSE 0 END AS written, count_if(n_chars < 20)::BIGINT AS refused FROM documents GROUP BY source",
    "manifest_scan": """SELECT CASE event_id % 3 WHEN 0 THEN 'a' ELSE 'b' END || '/event_type=' || CASE WHEN event_id % 5 = 0 THEN 'view' ELSE event_type END || '/f' || user_id || '.pdf' AS filename,
  arg_max(event_id, struct_pack(a := event_type, b := event_id))::VARCHAR AS document_id FROM events WHERE event_id % 6 <> 0 AND event_id % 3 < 2 GROUP BY 1""",
}
