"""Scans and sinks of corpora, parsed documents, manifests and logs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.functions.names import body_start, document_kind
from codicil.sources.shared import cut


def scan_corpus(spark: SparkSession, root: str, pattern: str = "*.pdf", category: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, relative, length, content) of files below a root, without those below a folder named debug.

    category: a part of the relative path, in either case.  Larger files than most_bytes are left out before
    their content is read.  Order by lower(relative) for a listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    base = root.split("://")[-1].rstrip("/")
    relative = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    d = files.load(root).withColumn("relative", relative)
    d = d.filter(~F.array_contains(F.split(F.lower("relative"), "/"), "debug"))
    if category:
        # Spark would read a file before it looks at its path, so those of the category are listed first, without content
        named = [r["path"] for r in d.filter(F.contains(F.lower("relative"), F.lit(category.lower()))).select("path").collect()]
        d = files.load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in named]).withColumn("relative", relative) if named else d.limit(0)
    return (d.filter(F.col("length") <= most_bytes) if most_bytes else d).select("path", "relative", "length", "content")


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("relative", F.sha2("content", 256).alias("sha256"), F.length(body_start(F.col("content"))).alias("body_bytes"))


def write_envelopes(documents: DataFrame, path: str) -> None:
    """One JSON line per document, below a folder for each kind: filename, sha256, model, parsed."""
    kind = document_kind(F.col("filename"))
    documents.select("filename", F.sha2(F.to_json("parsed"), 256).alias("sha256"), "model", "parsed", kind.alias("kind")).write.partitionBy("kind").json(path)


class Invalid(ValueError):
    """Rows that may not be written; `count` of them, and the first of their reasons."""

    def __init__(self, count: int, reasons: list[str]):
        super().__init__(f"{count} invalid: {', '.join(reasons)}")
        self.count = count


def write_if_all_valid(documents: DataFrame, path: str, problem: Column) -> None:
    """write_envelopes(), unless a row has a problem: a column that is null where the row is valid.  Then nothing is
    written and Invalid raised, with the first five reasons.  The rows are worked out once: what is looked at is what is written."""
    held = cut(documents.select(F.struct("filename", "model", "parsed").alias("row"), problem.alias("problem")), "to-validate")
    reasons = held.filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))
    first = reasons.orderBy("problem").limit(5).collect()
    if first:
        raise Invalid(reasons.agg(F.sum("n")).first()[0], [r["problem"] for r in first])
    write_envelopes(held.select("row.*"), path)


def publish_valid(documents: DataFrame, path: str, group: str, problem: Column) -> None:
    """Envelopes of those groups of documents that have no row with a problem, written once, audited and then published.

    Rows go to `rows` below the path, those with a problem in folders of their own; a verdict on each group is made from
    these and goes to `verdicts`; one small file in `commits` then shows all valid groups of this call at once.  Nothing
    is visible to published() before it, and what a run left that ended earlier never is.  Groups of any number and
    size, a null group being one: rows are spread evenly over files, large groups over several.
    """
    spark, batch = documents.sparkSession, f"b{uuid.uuid4().hex}"
    kind, key = document_kind(F.col("filename")), F.coalesce(F.concat(F.lit("k"), F.md5("group")), F.lit("null"))
    rows = documents.select("filename", F.sha2(F.to_json("parsed"), 256).alias("sha256"), "model", "parsed", F.col(group).cast("string").alias("group"), problem.alias("problem"))
    rows = rows.select("*", F.lit(batch).alias("batch"), key.alias("key"), F.col("problem").isNull().cast("string").alias("valid"), kind.alias("kind"))
    rows.hint("rebalance", "key", "valid").write.mode("append").partitionBy("batch", "key", "valid", "kind").json(f"{path}/rows")
    found = spark.read.schema(f"group string, problem string, {_PLACES}").json(f"{path}/rows").filter(F.col("batch") == batch)
    # lines are parsed for reasons in the folders of rows with a problem alone; the names of the groups are in the folders'
    keys = found.select("key").distinct()
    reasons = found.filter("valid = 'false'").groupBy("key", "problem").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("problem"))
    refused = reasons.withColumn("nth", nth).groupBy("key").agg(F.sum("n").alias("refused"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 5, F.col("problem")))).alias("reasons"))
    verdicts = keys.join(refused, "key", "left").select(F.lit(batch).alias("batch"), "key", F.coalesce("refused", F.lit(0)).cast("long").alias("refused"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
    verdicts.write.mode("append").parquet(f"{path}/verdicts")
    spark.range(1, numPartitions=1).select(F.lit(batch).alias("batch")).write.mode("append").json(f"{path}/commits")


_PLACES = "batch string, key string, valid string, kind string"


def published(spark: SparkSession, path: str, parsed: str) -> tuple[DataFrame, DataFrame]:
    """What publish_valid() has published below a path: (envelopes with group and kind, verdicts with refused and reasons)."""
    commits = spark.read.schema("batch string").json(f"{path}/commits")
    verdicts = spark.read.schema("batch string, key string, refused long, reasons array<string>").parquet(f"{path}/verdicts").join(commits, "batch", "left_semi")
    rows = spark.read.schema(f"filename string, sha256 string, model string, parsed {parsed}, group string, {_PLACES}").json(f"{path}/rows").filter("valid = 'true'")
    good = rows.join(verdicts.filter("refused = 0"), ["batch", "key"], "left_semi")
    return good.drop(*["batch", "key", "valid"]), verdicts


def read_envelopes(spark: SparkSession, path: str, parsed: str) -> tuple[DataFrame, DataFrame]:
    """Envelopes of a schema, and those that break it."""
    schema = f"filename string, sha256 string, model string, parsed {parsed}, _corrupt_record string"
    lines = spark.read.schema("value string, kind string").text(path)
    d = lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("_e"), "kind").select("_e.*", "kind")
    return d.filter("_corrupt_record IS NULL").drop("_corrupt_record"), d.filter("_corrupt_record IS NOT NULL").select("_corrupt_record")


def not_allowed(files: DataFrame, allowed: list[str]) -> DataFrame:
    """Files whose name is in no fixed list of sources."""
    return files.filter(~F.col("filename").isin(allowed))


def _nested(clauses: DataFrame) -> DataFrame:
    inner = lambda d, keys, name, fields: d.groupBy(*keys).agg(F.min("position").alias("position"), F.array_sort(F.collect_list(F.struct("position", *fields))).alias(name))
    without = lambda name: F.transform(name, lambda x: x.dropFields("position")).alias(name)
    subs = inner(clauses, ["chapter", "section", "subsection"], "clauses", ["clause", "text"])
    sections = inner(subs.withColumn("clauses", without("clauses")), ["chapter", "section"], "subsections", ["subsection", "clauses"])
    chapters = inner(sections.withColumn("subsections", without("subsections")), ["chapter"], "sections", ["section", "subsections"])
    return chapters.withColumn("sections", without("sections"))


def nested_master(clauses: DataFrame) -> DataFrame:
    """(chapter, sections): merged clauses (chapter, section, subsection, clause, text, position) as nested arrays, in order."""
    return _nested(clauses).orderBy("position").drop("position")


def write_nested_master(clauses: DataFrame, paths: list[str]) -> None:
    """nested_master() as JSON lines, worked out once and written to each place; what was there before is replaced."""
    held = cut(_nested(clauses), "nested-master")
    for path in paths:
        held.orderBy("position").drop("position").write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)
