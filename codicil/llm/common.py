"""What the operators of this subpackage share: shared storage, word counts and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all is one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codicil-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/codicil-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows, written to the shared folder and read again, and where they are."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again, so that a lost executor costs only what follows."""
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that written() made and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt_anew(key: str, kind: str = "binary") -> Column:
    """The same key, a binary, long or string column, as one by which rows are not dealt yet.

    A join by it shuffles both sides for itself, so that Spark splits a key that very many rows have
    (adaptive skew join); it cannot if a side is an aggregate by the same key.
    """
    return F.expr({"binary": f"concat({key}, X'')", "long": f"{key} ^ 0L", "string": f"concat({key}, '')"}[kind]).alias(key)


#: Lists of so many keys at most are broadcast.
BROADCAST_KEYS = 500_000
#: Copies of a row that one row of the first expansion stands for.
COPIES_AT_ONCE = 1000


def numbered_copies(marked: DataFrame, repeated: DataFrame) -> DataFrame:
    """(row, mark, copy) of marked (row, mark): copy is 0, but 0, 1, 2, … for equal rows whose mark is in repeated (mark).

    Equal rows are counted, which takes one row from each task, and expanded again in two steps, so that one that
    very many are equal to is spread; numbers do not depend on the partitions that rows come in.
    """
    n_repeated = repeated.count()
    if not n_repeated:
        return marked.select("row", "mark", F.lit(0).cast("long").alias("copy"))
    few = n_repeated <= BROADCAST_KEYS
    marks = (F.broadcast(repeated) if few else repeated.select(dealt_anew("mark", "long"))).withColumnRenamed("mark", "_again")
    found = (marked if few else marked.withColumn("mark", dealt_anew("mark", "long"))).join(marks, F.col("mark") == F.col("_again"), "left")
    copies = found.filter("_again IS NOT NULL").groupBy("row", "mark").agg(F.count("*").alias("n"))
    parts = copies.select("row", "mark", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES_AT_ONCE}"))).alias("part")).repartition("mark", "part")
    first = F.col("part") * COPIES_AT_ONCE
    expanded = parts.select("row", "mark", F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE - 1, F.col("n") - 1))).alias("copy"))
    return found.filter("_again IS NULL").select("row", "mark", F.lit(0).cast("long").alias("copy")).unionByName(expanded)


#: Bytes of keys and values, with what Python adds, that a Python worker remembers in one memo.
MEMO_BYTES = 128_000_000


class Memo(dict):
    """What `make` gives for texts or bytes, up to a bound on the memory; it starts anew beyond."""

    def __init__(self, make, most_bytes: int = MEMO_BYTES, longest: int = 64):
        super().__init__()
        self._make, self._most, self._longest, self._bytes = make, most_bytes, longest, 0

    def __missing__(self, key):
        value = self._make(key)
        if len(key) <= self._longest:
            self._bytes += 200 + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self._bytes > self._most:
                self.clear()
                self._bytes = 200
            self[key] = value
        return value


_KEPT: dict = {}


def kept(key: tuple, make):
    """make(), once per Python worker as long as it goes on with the same key: a worker that Spark reuses for
    another operator lets go of the vocabularies and memos of the one before."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def words(text: Column) -> Column:
    """The words of a text, null and empty texts having none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
