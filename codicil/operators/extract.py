"""A caller's own extraction over batches of pages, in order and with what the batch before left to carry on."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: extractor(texts of a batch's pages in order, carry of the batch before or None) gives (body, carry).
Extractor = Callable[[list[str], str | None], tuple[str, str | None]]
#: Results are handed to Spark in frames of so many.
FRAME = 64


def checkpoint_schema(pages: DataFrame) -> StructType:
    """(doc_id, key, start, body, carry, error): one row for each batch that was tried; body is null if it failed."""
    text = [StructField(c, StringType()) for c in ("body", "carry", "error")]
    return StructType([StructField("doc_id", pages.schema["doc_id"].dataType), StructField("key", StringType()), StructField("start", IntegerType()), *text])


def _tried(extractor: Extractor, attempts: int, texts: list[str], carry: str | None) -> tuple[str | None, str | None, str | None]:
    for left in reversed(range(attempts)):
        try:
            return (*extractor(texts, carry), None)
        except Exception as e:  # the caller's function may fail in any way; the row says how
            if not left:
                return None, carry, f"{type(e).__name__}: {e}"
    raise ValueError("at least one attempt")


def _fold(extractor: Extractor, attempts: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of whole documents in order of doc_id, start, key and page to the results of batches that are not done.

    One batch's texts are held at a time.  A document ends at its first batch that fails, as the next one needs its carry.
    """
    names = ["doc_id", "key", "start", "body", "carry", "error"]

    def results(frames):
        rows = (r for f in frames for r in f.itertuples(index=False))
        for doc_id, of_document in itertools.groupby(rows, lambda r: r.doc_id):
            carry = None
            for (start, key), of_batch in itertools.groupby(of_document, lambda r: (r.start, r.key)):
                first = next(of_batch)
                if first.done:
                    carry = first.carry
                    continue
                texts = [first.text, *(r.text for r in of_batch)]
                body, carry, error = _tried(extractor, attempts, texts, carry)
                yield doc_id, key, start, body, carry, error
                if error is not None:
                    break

    def run(frames):
        found = results(frames)
        while some := list(itertools.islice(found, FRAME)):
            yield pd.DataFrame(some, columns=names)

    return run


def extract_batches(pages: DataFrame, batches: DataFrame, extractor: Extractor, finished: DataFrame, attempts: int = 3) -> DataFrame:
    """checkpoint_schema() rows of the batches that have no row with a body in `finished`.

    pages (doc_id, page, text), batches as page_batches() gives them (doc_id, start, end, key), finished in
    checkpoint_schema().  A document's batches run one after the other, as each gets the carry of the one before, also
    where that one was finished earlier; documents run side by side.  Pages meet batches by doc_id and page, each
    page once for each batch that it is in, and stream through in order, so a task holds one batch however long a
    document is.  Documents without anything left to do take no part.  Missing pages are left out and batches
    without any page are not tried; a null text is empty; rows without a doc_id belong to no document.
    """
    have = finished.filter("body IS NOT NULL").groupBy("doc_id", "key").agg(F.max_by(F.struct("carry"), F.struct("body", "carry"))["carry"].alias("carry")).withColumn("done", F.lit(True))
    every = batches.filter("doc_id IS NOT NULL").select("doc_id", "key", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).distinct()
    every = every.join(have, ["doc_id", "key"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    open_ = every.filter("NOT done").select("doc_id").distinct()
    every = every.join(open_, "doc_id", "left_semi")
    done = every.filter("done").select("doc_id", "start", F.lit(0).alias("page"), "key", F.lit("").alias("text"), "carry", "done")
    asked = every.filter("NOT done").select("doc_id", "start", F.explode(F.sequence("start", "end")).alias("page"), "key", "carry", "done")
    held = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    rows = asked.join(held, ["doc_id", "page"]).select(*done.columns).unionByName(done)
    # the texts of a page that comes twice are put in an order of their own
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "start", "key", "page", "text")
    return ordered.mapInPandas(_fold(extractor, attempts), checkpoint_schema(pages))


def checkpoints(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What extract_to() has left below a path, nothing before its first run."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def extract_to(pages: DataFrame, batches: DataFrame, extractor: Extractor, path: str, rounds: int = 1, attempts: int = 3) -> DataFrame:
    """extract_batches() of what is left to do below a path, added there; returns the last result with a body of each batch.

    Documents go in `rounds` parts by a hash, each of which Spark commits by itself: a run that ends early loses the
    calls of one part alone, and the next run does only what is left.
    """
    spark, schema = pages.sparkSession, checkpoint_schema(pages)
    for part in range(rounds):
        mine = batches.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == part)
        extract_batches(pages, mine, extractor, checkpoints(spark, path, schema), attempts).write.mode("append").parquet(path)
    found = checkpoints(spark, path, schema).filter("body IS NOT NULL")
    last = found.groupBy("doc_id", "key").agg(F.max_by(F.struct("start", "body", "carry"), F.struct("body", "carry")).alias("_last"))
    return last.select("doc_id", "key", "_last.*")
