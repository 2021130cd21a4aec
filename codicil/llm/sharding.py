"""Sharding by a two-pass external shuffle.

The first pass scatters rows over buckets by a seeded hash, so that each bucket fits in memory.  The second
reads bucket after bucket, shuffles each by Fisher-Yates with a seed of its own and writes it.  The buckets, one
after the other, are a uniform shuffle of all rows, which is cut into shards whose row counts differ by one at most.
Buckets and shuffles depend on rows and seed alone, not on the partitions that rows come in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from codicil.llm.common import cut, discard, documents, numbered_copies, shared_path, written

SHARDS = 8
#: Bytes of texts of a bucket, about: a task holds it once as it comes and once shuffled.
BUCKET_BYTES = 32_000_000
#: A table with a row for each bucket is broadcast up to so many rows.
BROADCAST_ROWS = 500_000
_EMIT_ROWS = 2000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n rows: each place from the last on swaps with one drawn from those up to it."""
    draws = (np.random.default_rng([seed, bucket]).random(n) * np.arange(1, n + 1)).astype(np.int64)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(seed: int):
    """Rows (row, bucket) that come bucket after bucket, each bucket shuffled, with their places in it."""

    def emit(held, bucket):
        rows = pa.Table.from_batches(held)
        order = fisher_yates(rows.num_rows, seed, bucket)
        for lo in range(0, len(order), _EMIT_ROWS):
            part = rows.take(pa.array(order[lo : lo + _EMIT_ROWS])).combine_chunks()
            places = pa.array(np.arange(lo, lo + part.num_rows, dtype=np.int64))
            yield from part.append_column("place", places).to_batches()

    def shuffle(batches):
        held, current = [], None
        for b in batches:
            buckets = b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if held and buckets[lo] != current:
                    yield from emit(held, int(current))
                    held = []
                current = buckets[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from emit(held, int(current))

    return shuffle


def _scattered(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Rows (row, mark, copy, bucket) and how many buckets there are.

    The bucket is by a hash of the whole row, so equal rows meet in one.  Where those alone would exceed a bucket, copies are
    numbered and get buckets of their own.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes"))
    marked = whole.withColumn("mark", F.xxhash64(F.lit(seed), F.col("row")))
    totals = Observation()
    counted = marked.groupBy("mark").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).observe(totals, F.sum("bytes").alias("bytes"))
    hot = cut(counted.filter((F.col("n") > 1) & (F.col("bytes") > bucket_bytes)).select("mark"), "hot-rows")
    buckets = max(1, math.ceil((totals.get["bytes"] or 0) / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "mark", "copy"), F.lit(buckets)).cast("int").alias("bucket")
    return numbered_copies(marked.select("row", "mark"), hot).withColumn("bucket", bucket), buckets


def shuffled_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all rows, shuffled, to `shards` shards: Parquet below `folder`/shard=k, with all columns of docs in a column row,
    and a column slot, the place in the shard.  Returns the written table (shard, slot, row).

    Shards' row counts differ by one at most, and slots have no gap.  Equal rows are rows of their own; null and empty
    texts are rows like others; a very long text makes its bucket larger.  Columns may have any names (docs needs a
    column text, for sizes) but no maps, which have no hash.  An empty table has no rows and leaves an empty table.
    """
    spark = docs.sparkSession
    scattered, buckets = _scattered(docs, seed, bucket_bytes)
    ordered = scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket", "mark", "copy").select("row", "bucket")
    schema = StructType(list(ordered.schema.fields)).add("place", LongType())
    placed, path = written(ordered.mapInArrow(_shuffled(seed), schema), "shuffled-buckets")
    counts = cut(placed.groupBy("bucket").agg(F.count("*").alias("n")), "bucket-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))
    at = placed.join(F.broadcast(starts) if buckets <= BROADCAST_ROWS else starts, "bucket").withColumn("at", F.col("start") + F.col("place"))
    shard = F.expr(f"at * {shards}L div {max(1, total)}L").cast("int")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    out = at.withColumn("shard", shard).select("shard", (F.col("at") - first).cast("long").alias("slot"), "row")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    discard(spark, path)
    files = StructType().add("slot", LongType()).add("row", ordered.schema["row"].dataType).add("shard", IntegerType())
    return spark.read.schema(files).parquet(folder).select("shard", "slot", "row")


def op12_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: counts at most one apart."""
    done = shuffled_shards(documents(spark, sf_dir), shared_path(spark, "shards"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    return done.select(F.col("row.doc_id").alias("doc_id"), size, F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
