"""From text to pages, verdicts, documents and reports."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codicil.functions import text as X


def split_pages(docs: DataFrame, lines_per_page: int = 4) -> DataFrame:
    """(keys, page, text): a text's lines, so many to a page, page numbers from 1.  No shuffle."""
    starts = lambda lines: F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_page).cast("int"))
    cut = lambda lines: F.transform(starts(lines), lambda i: F.array_join(F.slice(lines, i * lines_per_page + 1, lines_per_page), "\n"))
    # the text is split once, not once a page; no text is without pages, and an outer explode keeps Spark from
    # making them a second time for a filter on their number
    pages = X.let(F.split(F.coalesce("text", F.lit("")), "\n"), cut)
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.posexplode_outer(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def route_pages(pages: DataFrame) -> DataFrame:
    """Pages with their English text, its statistics, the verdict, and how the text is to be had."""
    english = pages.withColumn("english", X.english_lines(F.col("text")))
    verdict = X.page_verdict(F.col("english"), latin=F.col("latin_characters"), words=F.col("english_words"))
    return (
        english.withColumn("latin_characters", X.latin_characters(F.col("english")))
        .withColumn("english_words", X.english_words(F.col("english")))
        .withColumn("reason", verdict)
        .withColumn("method", F.when(F.col("reason") == "good", "native_text").otherwise("fallback"))
    )


def roll_up(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per document: pages per method, empty pages, review flag, the full text in page order."""
    page_text = F.array_sort(F.collect_list(F.struct("page", "english")))
    joined = F.array_join(F.transform(F.filter(page_text, lambda p: F.trim(p["english"]) != ""), lambda p: p["english"]), "\n\n")
    return pages.groupBy(*keys).agg(
        F.count("*").alias("total_pages"),
        F.count_if(F.col("method") == "native_text").alias("native_pages"),
        F.count_if(F.col("method") != "native_text").alias("fallback_pages"),
        F.count_if(F.col("reason") == "empty").alias("empty_pages"),
        (F.count_if(F.col("reason") == "empty") > 0).alias("requires_review"),
        joined.alias("full_text"),
    )


def text_report(pages: DataFrame, key: str, header: Column) -> DataFrame:
    """(key, report): header lines, then each page under a ruled heading, in page order."""
    ruled = F.concat(F.lit("=" * 40 + "\nPAGE "), F.col("page").cast("string"), F.lit(" ["), F.col("method"), F.lit("]\n" + "=" * 40 + "\n"))
    body = F.when(F.trim("english") == "", "[NO ENGLISH TEXT]").otherwise(F.col("english"))
    parts = F.array_sort(F.collect_list(F.struct("page", F.concat(ruled, body).alias("part"))))
    return pages.groupBy(key).agg(F.concat(F.min(header), F.lit("\n"), F.array_join(F.transform(parts, lambda p: p["part"]), "\n")).alias("report"))


def page_batches(docs: DataFrame, n_pages: str, size: int = 20, overlap: int = 2) -> DataFrame:
    """(…, batch, start, end, key) of overlapping batches; the last ends at the last page, no pages give none."""
    stride = size - overlap
    if stride < 1:
        raise ValueError("a batch must be larger than its overlap")
    n = F.col(n_pages).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - overlap, F.lit(1)), F.lit(stride)))
    d = docs.select("*", F.posexplode(starts).alias("batch", "start"))
    d = d.withColumn("end", F.least(F.col("start") + size - 1, n))
    return d.withColumn("key", F.format_string("pages-%04d-%04d", "start", "end"))


def all_pages_present(pages: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, found, total, complete): whether each document has all of its pages."""
    found = pages.groupBy(key).agg(F.count_distinct("page").alias("found"))
    return totals.join(found, key, "left").select(key, F.coalesce("found", F.lit(0)).alias("found"), "total", (F.coalesce("found", F.lit(0)) == F.col("total")).alias("complete"))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalized(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with NFKC text.  ASCII texts are so already and do not pass through Python."""
    plain = F.coalesce(F.col(column), F.lit("")).rlike(r"\A\p{ASCII}*\z")
    return docs.filter(plain).unionByName(docs.filter(~plain).withColumn(column, _nfkc(F.col(column))))


def conversion_state(docs: DataFrame, outputs: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """docs with state: complete if both outputs are there, partial if a checkpoint is, else pending."""
    kinds = outputs.groupBy(key).agg((F.count_distinct("kind") >= 2).alias("_both"))
    marks = checkpoints.select(key).distinct().withColumn("_mark", F.lit(True))
    d = docs.join(kinds, key, "left").join(marks, key, "left")
    return d.withColumn("state", F.when(F.col("_both"), "complete").when(F.col("_mark"), "partial").otherwise("pending")).drop("_both", "_mark")
