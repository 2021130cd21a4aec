"""Ordered lists of notes under a key, kept in chunks, so that no row grows with a list.

A list's elements are ranked by a sort that Spark splits by range, also within a list, and every so many
ranks are one chunk.  The whole text of a list is made only where it is asked for; its hash needs no such text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.sources.shared import cut

#: Elements of a chunk.
CHUNK = 1000


def ranked(rows: DataFrame, key: str, element: str, order: list[str], distinct: bool = True) -> DataFrame:
    """(key, rank, element): each key's elements in order, from rank 0; if distinct, each at its first place only.

    Null and empty elements are left out; of equal places the lesser element comes first.  No task holds a list.
    """
    d = rows.filter(F.coalesce(F.col(element).cast("string"), F.lit("")) != "").select(key, element, F.struct(*order).alias("_place"))
    if distinct:
        d = d.groupBy(key, element).agg(F.min("_place").alias("_place"))
    by = [F.col(key), F.col("_place"), F.col(element)]
    ordered = d.repartitionByRange(*by).sortWithinPartitions(*by).select(key, element, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    ordered = cut(ordered, "ranked")  # the bounds of the ranges must not change between counting and ranking
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = ordered.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.select(key, (F.col("_before") + F.col("_at") - F.col("_from")).cast("long").alias("rank"), element)


def chunks(rows: DataFrame, key: str, element: str, sep: str = "; ", size: int = CHUNK) -> DataFrame:
    """(key, chunk, text) of ranked(): every `size` elements of a list as one text."""
    held = F.array_sort(F.collect_list(F.struct("rank", F.col(element).cast("string").alias("e"))))
    text = F.array_join(F.transform(held, lambda x: x["e"]), sep)
    return rows.groupBy(key, F.expr(f"rank div {size}").alias("chunk")).agg(text.alias("text"))


def texts(pieces: DataFrame, key: str, sep: str = "; ") -> DataFrame:
    """(key, text) of chunks(): each list as one text, for a sink that wants it so."""
    held = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["text"]), sep).alias("text"))


def digests(pieces: DataFrame, key: str, sep: str = "; ") -> DataFrame:
    """(key, md5, chars) of each list's text, from its chunks as they stream by in order."""
    names, between = ["key", "md5", "chars"], sep.encode()

    def hashed(batches):
        now, h, chars = None, None, 0
        for b in batches:
            out = []
            for k, text in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if h is None or k != now:
                    if h is not None:
                        out.append((now, h.hexdigest(), chars))
                    now, h, chars = k, hashlib.md5(text.encode()), len(text)
                else:
                    h.update(between + text.encode())
                    chars += len(sep) + len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=names)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([h.hexdigest()]), pa.array([chars], pa.int64())], names=names)

    ordered = pieces.select(F.col(key).cast("string").alias("key"), "chunk", "text").repartition("key").sortWithinPartitions("key", "chunk")
    return ordered.select("key", "text").mapInArrow(hashed, "key string, md5 string, chars long").withColumnRenamed("key", key)


def listed(rows: DataFrame, key: str, element: Column, order: list[str], distinct: bool = True, sep: str = "; ", size: int = CHUNK) -> DataFrame:
    """chunks() of the ranked() elements that a column of rows gives."""
    return chunks(ranked(rows.withColumn("_element", element), key, "_element", order, distinct), key, "_element", sep, size)
