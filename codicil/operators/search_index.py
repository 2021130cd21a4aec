"""Literal search by posting lists of character trigrams, written once and read by each query's own trigrams."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codicil.functions.text import let as _let
from codicil.sources.shared import cut

#: Code points of a text that are cut into trigrams at once; a longer text is several such pieces.
PIECE = 4096
#: So many texts share one list of a trigram at most, so no list is longer and a hot trigram has many.
TEXTS_PER_LIST = 4096
#: A task holds about so many entries of lists at once, and hands on so many lists at a time.
ENTRIES_PER_LIST, ROWS_AT_ONCE = 2_000_000, 10_000
#: Texts that are kept in one folder, of which a query reads those that hold a candidate.
TEXTS_PER_FOLDER = 20_000
MOST_FOLDERS = 4096
#: Trigrams of a longer query that are looked up, spread over it; what they find is verified as a whole anyway.
MOST_GRAMS = 64
#: Up to so many candidates are broadcast to the folders they are in.
BROADCAST_CANDIDATES = 100_000

# Put after a text, so that each of its characters starts a trigram and a query of two finds those that end with it.
_END = "\x00\x00"


def _pieces(text: Column) -> Column:
    """A text in pieces, each with the first two characters of the next."""
    overlapping = lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(p, i + 1), 1, 2), F.lit(""))))
    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), overlapping)


def _trigrams(text: str) -> list[int]:
    """The different trigrams of a text as numbers of three code points, in order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]).tolist()


def _spelt(gram: int) -> str:
    return chr(gram >> 42) + chr(gram >> 21 & 0x1FFFFF) + chr(gram & 0x1FFFFF)


def postings(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(gram, list, docs): the texts that hold a trigram, sorted, in lists of texts that a task reads one after the other.

    A text is cut into pieces that overlap by two characters, so a long one is many short rows; all of them go to one
    list.  A list is whole where it is made, so no trigram is shuffled before it stands for all texts of its list.
    """
    most_texts, most_entries = TEXTS_PER_LIST, ENTRIES_PER_LIST

    def lists(batches):
        held, last, n, entries, number = {}, None, 0, 0, TaskContext.get().partitionId() << 32

        def full():
            grams = sorted(held)
            docs = [sorted(set(held[g])) for g in grams]
            for lo in range(0, len(grams), ROWS_AT_ONCE):
                at = grams[lo : lo + ROWS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(map(_spelt, at), pa.string()), pa.array([number] * len(at), pa.int64()), pa.array(docs[lo : lo + ROWS_AT_ONCE], pa.list_(pa.int64()))], names=["gram", "list", "docs"])

        for b in batches:
            for of, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if of != last:
                    if n >= most_texts or entries >= most_entries:
                        yield from full()
                        held, n, entries, number = {}, 0, 0, number + 1
                    last, n = of, n + 1
                for g in _trigrams(piece):
                    docs = held.setdefault(g, [])
                    if not docs or docs[-1] != of:
                        docs.append(of)
                        entries += 1
        yield from full()

    whole = F.concat(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_END))
    pieces = texts.select(F.col(doc).cast("long").alias("doc"), F.explode(_pieces(whole)).alias("_piece")).filter((F.length("_piece") >= 3) & F.col("doc").isNotNull())
    return pieces.mapInArrow(lists, "gram string, list long, docs array<long>")


def write_index(texts: DataFrame, path: str, doc: str = "doc", text: str = "text") -> None:
    """Writes the texts and their posting lists below path.

    texts: one row each, with a long number of its own in `doc` and any other columns, which are kept; rows of
    one number are found together.  Null texts count as empty.  Posting lists lie in the order of their
    trigrams, so that the statistics of the files tell which parts a query needs.
    """
    n = max(1, texts.count())
    folders = min(MOST_FOLDERS, -(-n // TEXTS_PER_FOLDER))
    placed = texts.withColumn("folder", F.pmod(F.xxhash64(doc), F.lit(folders)).cast("int"))
    placed.repartition("folder", F.pmod(F.xxhash64(F.lit(1), F.col(doc)), F.lit(-(-n // (folders * TEXTS_PER_FOLDER))))).sortWithinPartitions("folder", doc).write.partitionBy("folder").parquet(f"{path}/texts")
    texts.sparkSession.range(1).select(F.lit(folders).alias("folders"), F.lit(placed.schema.json()).alias("columns")).write.parquet(f"{path}/about")
    lists = cut(postings(texts, doc, text), "lists")  # a range sort reads what it sorts twice
    lists.repartitionByRange("gram", "list").sortWithinPartitions("gram", "list").write.parquet(f"{path}/postings")


def query_grams(query: str) -> list[str]:
    """The trigrams of a query that are looked up; of a query of two characters that alone, as a beginning."""
    found = list(dict.fromkeys(query[i : i + 3] for i in range(len(query) - 2)))
    step = -(-len(found) // MOST_GRAMS)
    return found[:: max(1, step)] or [query]


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(doc): the texts that hold all trigrams of a query of two characters or more, in lower case.

    Only the lists of these trigrams are read; they are intersected list by list, so no task holds more than
    one short array for each trigram.
    """
    lists = spark.read.parquet(f"{path}/postings")
    grams = query_grams(query)
    if len(query) == 2:
        return lists.filter(F.col("gram").startswith(query)).select(F.explode("docs").alias("doc")).distinct()
    asked = F.col("gram") == grams[0]
    for g in grams[1:]:
        asked = asked | (F.col("gram") == g)
    together = lists.filter(asked).groupBy("list").agg(F.count("*").alias("_n"), F.collect_list("docs").alias("_docs")).filter(F.col("_n") == len(grams))
    common = F.aggregate(F.slice("_docs", 2, len(grams)), F.get("_docs", F.lit(0)), F.array_intersect)
    return together.select(F.explode(common).alias("doc"))


def find(spark: SparkSession, path: str, query: str, doc: str = "doc", text: str = "text") -> DataFrame:
    """The rows of an index whose text holds a query literally, whatever the case; none for under two characters.

    Folders of texts without a candidate are not read where the candidates are few enough to be broadcast, and
    each candidate is verified by its whole text.
    """
    return _holding(spark, path, query.strip().lower(), doc, text)


def _holding(spark: SparkSession, path: str, q: str, doc: str, text: str) -> DataFrame:
    about = spark.read.parquet(f"{path}/about").first()
    texts = spark.read.schema(StructType.fromJson(json.loads(about["columns"]))).parquet(f"{path}/texts")
    if len(q) < 2:
        return texts.limit(0).drop("folder")
    docs = candidates(spark, path, q)
    docs = docs.select(F.col("doc").alias("_doc"), F.pmod(F.xxhash64("doc"), F.lit(about["folders"])).cast("int").alias("_folder"))
    few = docs.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
    hit = F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(q))
    return texts.join(F.broadcast(docs) if few else docs, (F.col(doc) == F.col("_doc")) & (F.col("folder") == F.col("_folder")), "left_semi").filter(hit).drop("folder")


def search(spark: SparkSession, path: str, query: str, limit: int = 6, doc: str = "doc", text: str = "text", order: str = "position") -> DataFrame:
    """The first rows by `order` that find() finds."""
    return find(spark, path, query, doc, text).orderBy(order).limit(limit)


def find_parts(spark: SparkSession, path: str, query: str, keys: list[str], rows: int, more: int, doc: str = "doc", text: str = "part") -> DataFrame:
    """(keys): the texts that hold a query, of an index of their parts as reader.search_parts() makes them.

    A part holds `more` characters of the next at least, so a query that is no longer by more than one is whole in a
    part.  Of a longer one the beginning is looked up, and what follows a hit is read: all parts but the last have `rows`
    characters at least, so the query says how many.
    """
    q = query.strip().lower()
    hits = _holding(spark, path, q[: more + 1], doc, text)
    if len(q) <= more + 1:
        return hits.select(*keys).distinct()
    following = F.explode(F.sequence("nth", F.col("nth") + -(-len(q) // rows))).alias("nth")
    asked = hits.select(F.struct(*keys).alias("_of"), F.col("nth").alias("_from"), following)
    own = spark.read.schema(hits.schema).parquet(f"{path}/texts").select(F.struct(*keys).alias("_of"), "nth", F.left(F.col(text), F.col("own")).alias("_text"))
    held = F.array_sort(F.collect_list(F.struct("nth", "_text")))
    whole = asked.join(own, ["_of", "nth"]).groupBy("_of", "_from").agg(F.array_join(F.transform(held, lambda x: x["_text"]), "").alias("_text"))
    return whole.filter(F.contains("_text", F.lit(q))).select("_of.*").distinct()
