"""Manifests of harvested documents: upserts, resuming, identities, headers and harvesting stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Rows of listings that hold no entry.
PLACEHOLDER_ROWS = ["no data available", "no matching records", "no entries to show", "processing...", "loading..."]


def resolve_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with _key: the document_id, that of the only id with the same key columns, or those columns.

    Rows without an id whose columns belong to several ids are ambiguous; `_ambiguous` marks them.
    """
    has = F.coalesce("document_id", F.lit("")) != ""
    ids = rows.filter(has).groupBy(*key).agg(F.min("document_id").alias("_id"), F.count_distinct("document_id").alias("_ids"))
    d = rows.join(ids, key, "left")
    by_key = F.concat_ws("\x1f", F.lit("key"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    own = F.concat(F.lit("id\x1f"), F.col("document_id"))
    return d.withColumn("_ambiguous", ~has & (F.coalesce("_ids", F.lit(0)) > 1)).withColumn("_key", F.when(has, own).when(F.col("_ids") == 1, F.concat(F.lit("id\x1f"), F.col("_id"))).otherwise(by_key)).drop("_id", "_ids")


def upsert(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each document, at the place of its first one (`position`).

    A document is its id, else its key columns.  One groupBy; ambiguous rows are left out, see resolve_ids().
    """
    keyed = resolve_ids(rows, key).filter("NOT _ambiguous")
    last = keyed.groupBy("_key").agg(F.max_by(F.struct(*rows.columns), seq).alias("_row"), F.min(seq).alias("position"))
    return last.select("_row.*", "position")


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each combination of keys, null being a value of its own."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_nth = 1").drop("_nth")


def pending(documents: DataFrame, finished: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Documents that are still to do."""
    return documents if force else documents.join(finished.select(*key).distinct(), key, "left_anti")


def valid_batches(batches: DataFrame, checkpoints: DataFrame, valid: Column) -> DataFrame:
    """Batches to do: those without a checkpoint that is valid."""
    return batches.join(checkpoints.filter(valid).select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")


def original_name(filename: Column) -> Column:
    """The original file of `… (STEM).pdf`, `… (STEM) [n].pdf` or `digits.pdf`, in lower case."""
    stem = F.coalesce(
        F.nullif(F.trim(F.regexp_extract(filename, r"(?i)\(([^()]+)\)(?:\s*\[[0-9]+\])?\.pdf$", 1)), F.lit("")), F.nullif(F.regexp_extract(filename, r"(?i)^([0-9]+)\.pdf$", 1), F.lit(""))
    )
    return F.lower(F.concat(stem, F.lit(".pdf")))


def new_originals(candidates: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Candidates whose original is not there yet, the first of each original."""
    have = existing.select(original_name(F.col("filename")).alias("_original")).distinct()
    c = candidates.withColumn("_original", F.lower("original"))
    return first_of_each(c.join(have, "_original", "left_anti"), ["_original"], order).drop("_original")


def document_ids(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path) with document_id and document_id_source: manifest, filename or stem."""
    m = manifest.filter("document_id <> '' AND filename <> ''").groupBy(F.col("filename").alias("path")).agg(F.max_by("document_id", "seq").alias("_id"))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    number = F.nullif(F.regexp_extract(stem, r"\(([0-9]{3,})\)\s*$", 1), F.lit(""))
    source = F.when(F.col("_id").isNotNull(), "manifest").when(number.isNotNull(), "filename").otherwise("stem")
    return files.join(m, "path", "left").select(*files.columns, F.coalesce("_id", number, stem).alias("document_id"), source.alias("document_id_source"))


def canonical_rows(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(row_id, header, value) from rows (row_id, headers, cells) by canonical headers; unknown ones pass through.

    aliases (alias, header) is a list of any length; Spark broadcasts it while it is small.  A row without a serial number takes an all-digit first cell.
    """
    from codicil.functions.text import squeeze

    zipped = F.filter(F.arrays_zip(F.col("headers").alias("h"), F.col("cells").alias("c")), lambda x: x["h"].isNotNull() & x["c"].isNotNull())
    d = rows.select("row_id", F.explode(zipped).alias("x"))
    d = d.select("row_id", F.replace(F.lower(squeeze(F.col("x.h"))), F.lit("organisation"), F.lit("organization")).alias("alias"), squeeze(F.col("x.c")).alias("value"))
    d = d.join(aliases, "alias", "left").select("row_id", F.coalesce("header", "alias").alias("header"), "value")
    first = rows.select("row_id", squeeze(F.get("cells", F.lit(0))).alias("value")).filter("value RLIKE '^[0-9]+$'")
    serial = d.filter("header = 's. no.' AND value <> ''").select("row_id")
    return d.unionByName(first.join(serial, "row_id", "left_anti").select("row_id", F.lit("s. no.").alias("header"), "value"))


def harvest_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, label) of the links of stored pages, in order."""
    links = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), 0)
    d = pages.select("page_id", F.posexplode(links).alias("position", "_a"))
    href = F.regexp_extract("_a", r"(?is)href=[\"']([^\"']*)[\"']", 1)
    label = F.trim(F.regexp_replace(F.regexp_replace("_a", "(?s)<[^>]*>", ""), r"\s+", " "))
    return d.select("page_id", "position", href.alias("href"), label.alias("label"))


def listing_rows(rows: DataFrame, need_date: bool = True) -> DataFrame:
    """rows (…, document_id, cells array) with date and reason: null if accepted; placeholder rows are dropped.

    The date is the first d/m/yyyy of a cell, else of the row's text.
    """
    text = F.array_join("cells", " ")
    low = F.lower(text)
    holds_none = F.exists(F.array(*map(F.lit, PLACEHOLDER_ROWS)), lambda p: F.contains(low, p))
    pattern = "([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
    in_cell = F.get(F.filter(F.transform("cells", lambda c: F.regexp_extract(c, f"^\\s*{pattern}\\s*$", 1)), lambda x: x != ""), F.lit(0))
    date = F.coalesce(in_cell, F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
    d = rows.filter(~holds_none).withColumn("date", date)
    reason = F.when(F.coalesce("document_id", F.lit("")) == "", "no id")
    return d.withColumn("reason", reason.when(F.col("date").isNull(), "no date") if need_date else reason)


def run_summary(log: DataFrame) -> DataFrame:
    """One row: how many documents are downloaded, were there already, failed; and pages."""
    s = F.col("status")
    return log.agg(
        F.count_if(s.isin("complete", "downloaded")).alias("done"), F.count_if(s.isin("skipped", "already-exists")).alias("skipped"), F.count_if(s.startswith("ERROR") | (s == "failed")).alias("failed"), F.sum("pages").alias("pages")
    )


def listing_gap(parsed: DataFrame, listed: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, parsed, listed, verdict): ok, warn on any difference, fail beyond `most`."""
    p = parsed.groupBy(key).agg(F.count("*").alias("parsed"))
    d = listed.join(p, key, "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    gap = F.abs(F.col("listed") - F.col("parsed"))
    return d.select(key, "parsed", "listed", F.when(gap > most, "fail").when(gap > 0, "warn").otherwise("ok").alias("verdict"))


