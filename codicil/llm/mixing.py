"""Mixing sources to target weights.

Tokens are summed per source, sources get a target by weight, and every document is taken
floor(rate) times plus once more with a probability of the rate's fraction, decided by a hash of its id and
text and, among equal rows, its number, so that reruns agree and no task needs to see another document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.llm.common import SPACE, cut, documents, numbered_copies

#: Sources up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text, null having none: each run is made one letter, and the white space between taken out."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), "[^" + SPACE[1:] + "+", "x")
    return F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")).cast("long")


def chance(seed: str, *keys: Column) -> Column:
    """A number from 0 to below 1 that depends on the keys and the seed alone."""
    whole = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(whole), 1, 12), 16, 10).cast("double") / float(16**12)


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of sources, given (source, source_size).

    Sources by code point, null last, take the weights in turn.  All targets sum to `share` of all
    sizes; a target stops at `most` times its source's size and the excess goes to the others by
    weight.  That is a water level: target = min(most * size, level * weight).  Sources that stop
    are those whose most * size / weight is lowest, so one sorted running sum finds the level.
    The input has a row for each source; sorting those is one task's work.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy(F.col("_ceiling") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_weight", turn).withColumn("_ceiling", F.col("source_size") * F.lit(most))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / F.sum("_weight").over(after))
    free = F.when(F.col("_ceiling") > F.col("_level") * F.col("_weight"), F.col("_level"))
    s = s.withColumn("_water", F.first(free, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_water").isNull(), F.col("_ceiling")).otherwise(F.least("_ceiling", F.col("_water") * F.col("_weight")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with a column _mix: a struct of size, source_size, target (its source's) and copies, how often the mix takes the row.

    size: a column of whole numbers, by default the words of `text`; null counts as 0, so null, empty and blank
    texts have size 0.  Very long texts are counted whole.  A null source is a source.  Each row has a chance of its own,
    also rows of one id or none: it depends on id and text, and among equal rows on a number that these get.  An empty
    table gives none.  A source of size 0 has target 0 and its rows are taken 0 times.  Rows are held in a struct meanwhile, so column names may be any; a column _mix is replaced.
    """
    sized = docs.select(F.coalesce((word_count(F.col("text")) if size is None else size).cast("long"), F.lit(0).cast("long")).alias("size"), F.col("source").alias("of"), F.struct(*docs.columns).alias("row"))
    marked = sized.select(F.struct("size", "of", "row").alias("row")).withColumn("mark", F.xxhash64("row.row"))
    repeated = cut(marked.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "mix-repeated")
    sums = sized.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sums, weights, share, most), "mix-sources")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mixed = numbered_copies(marked, repeated).select("row.*", "copy").join(targets, F.col("of").eqNullSafe(F.col("source")), "left").withColumn("rate", rate)
    extra = chance(seed, F.col("row.doc_id"), F.md5(F.coalesce("row.text", F.lit(""))), F.col("copy")) < F.col("rate") - F.floor("rate")
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c != "_mix"]
    return mixed.select(*columns, F.struct("size", "source_size", "target", (F.floor("rate") + extra.cast("long")).alias("copies")).alias("_mix"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as the mix takes it, without the column _mix.

    Rows taken 0 times go; texts, null ones too, and other columns stay as they are.  An empty table gives none.
    """
    columns = [c for c in mixed.columns if c != "_mix"]
    held = mixed.select(F.struct(*columns).alias("row"), F.explode(F.array_repeat(F.lit(True), F.col("_mix.copies").cast("int"))))
    return held.select(*[F.col("row")[c].alias(c) for c in columns])


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    m = lambda c: F.col("_mix")[c]
    return mix(docs).select("doc_id", *[m(c).alias(c) for c in ("size", "source_size", "target")], (m("size") * m("copies")).alias("taken"), m("copies").alias("copies"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1) AS coin FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
    sum(size)::DOUBLE * 2.0 AS ceiling FROM sized GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s WINDOW f AS (ORDER BY ceiling / w, source NULLS LAST)),
water AS (SELECT arg_min(level, struct_pack(a := ceiling / w, b := source)) FILTER (ceiling > level * w) AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(ceiling, water.level * w), ceiling) AS target FROM l, water),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coin), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken,
  floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM r
"""
