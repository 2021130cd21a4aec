"""Token counts by an exact length histogram.

Documents are encoded once and summed up per encoded length.  All that is asked later comes from
that histogram: suffix sums give, for every context limit, how many documents reach it, how many
tokens they have, and how many tokens stay when each text is cut at the limit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.llm.common import documents
from codicil.llm.tokens import BYTE_BPE, encoder


#: The columns that length_histogram() makes.
MADE = ("length", "n_docs", "n_tokens", "docs_from", "tokens_from", "kept_tokens", "below")


def _own_names(columns: list[str], made=MADE) -> list[str]:
    """Names that differ from those made here: with an underscore behind where they do not."""
    return [c + "_" if c in made else c for c in columns]


def with_token_counts(docs: DataFrame, keep: list[str], tokenizer: str = BYTE_BPE) -> DataFrame:
    """The columns `keep` and n_tokens, the ids that the tokenizer gives for the whole text (null: 0).

    A kept column n_tokens gets an underscore behind its name.  Texts of any length are
    encoded whole; repeated rows count each; an empty table gives no rows.
    """
    names = _own_names(keep, ("n_tokens",))

    def count(batches):
        e = encoder(tokenizer)
        for b in batches:
            n = [len(e.encode(t.as_py())) // 4 for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    d = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("_text"))
    return d.mapInArrow(count, d.select(*names, F.lit(0).cast("long").alias("n_tokens")).schema)


def length_histogram(counted: DataFrame, by: list[str]) -> DataFrame:
    """A row for each length and group: documents and tokens of that length, and suffix sums from it on.

    n_docs, n_tokens: of documents of exactly `length` tokens.  docs_from, tokens_from: of those as long
    or longer.  kept_tokens: tokens that stay when every text is cut at `length`.  below: share of the
    documents that are shorter, so a quantile q is the largest length with below <= q.
    The window sorts one row per different length, however many documents there are.  A null group is a
    group; an empty table gives no rows; empty texts have length 0; repeated rows count each.  Groups may have any names;
    those of columns made here get an underscore behind.
    """
    hist = counted.groupBy(F.struct(F.lit(0), *by).alias("_group"), F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    from_here = Window.partitionBy("_group").orderBy(F.col("length").desc())
    whole = Window.partitionBy("_group")
    hist = (
        hist.withColumn("docs_from", F.sum("n_docs").over(from_here))
        .withColumn("tokens_from", F.sum("n_tokens").over(from_here))
        .withColumn("kept_tokens", F.sum("n_tokens").over(whole) - F.col("tokens_from") + F.col("length") * F.col("docs_from"))
        .withColumn("below", 1 - F.col("docs_from") / F.sum("n_docs").over(whole))
    )
    return hist.select(*[F.col("_group")[c].alias(n) for c, n in zip(by, _own_names(by), strict=True)], *MADE)


def totals_at(histogram: DataFrame, limit: int, by: list[str]) -> DataFrame:
    """Totals, truncated totals and documents over the limit, from the histogram alone."""
    over = F.col("length") > limit
    return histogram.groupBy(*by).agg(
        F.sum("n_docs").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(over, F.col("n_docs") * limit).otherwise(F.col("n_tokens"))).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
    )


def quantile_at(histogram: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, length): for each group the largest length that at most a share q of its documents is shorter than."""
    return histogram.filter(F.col("below") <= q).groupBy(*by).agg(F.max("length").alias("length"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(with_token_counts(documents(spark, sf_dir), ["lang"]), ["lang"])
