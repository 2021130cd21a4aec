"""Queries by posting lists: sections of the statute, whole documents, revisions and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import reader as R
from codicil.operators import search_index as I
from codicil.plans.reader_queries import ORACLE_SQL as READER_SQL
from codicil.plans.reader_queries import revisions
from codicil.plans.statute_queries import ORACLE_SQL as STATUTE_SQL
from codicil.plans.statute_queries import fragments
from codicil.sources.shared import cut, shared_path
from codicil.sources.tables import table

#: What is asked of the documents: words, parts of words across blanks and line ends, two letters, a phrase of one text.
ASKED = ["The end", "tion. The", ".\nA", "é", "èé", " zq", "thingingtion of", "qui est de la", "schlich", "of the and to"]


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six sections in reading order that hold a phrase, by posting lists."""
    path = shared_path(spark, "sections")
    parts = cut(R.search_parts(fragments(spark, sf_dir)), "parts")  # an index reads its texts three times
    I.write_index(parts.withColumn("doc", F.xxhash64("chapter", "section", "nth")), path, text="part")
    hits = I.find_parts(spark, path, "  STATE p and ", ["chapter", "section", "position"], R.PART_ROWS, R.MORE_ROWS)
    return hits.orderBy("position").limit(6)


def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 on whole documents: all that hold each of several queries."""
    path = shared_path(spark, "texts")
    I.write_index(table(spark, sf_dir, "documents").select("doc_id", "text"), path, doc="doc_id")
    hits = [I.find(spark, path, q, doc="doc_id").select(F.lit(i).alias("query_no"), "doc_id") for i, q in enumerate(ASKED)]
    return reduce(DataFrame.unionByName, hits)


def indexed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revisions and messages by substring, by posting lists."""
    old, box = shared_path(spark, "revisions"), shared_path(spark, "messages")
    I.write_index(revisions(spark, sf_dir).withColumn("blob", R.revision_text()), old, doc="id", text="blob")
    I.write_index(table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat_ws(' ', c_name, c_mktsegment) AS blob"), box, doc="id", text="blob")
    hits = R.change_history(I.find(spark, old, "1-urgent", doc="id", text="blob"), "1-urgent", "callout_*")
    found = I.find(spark, box, "BUILD", doc="id", text="blob")
    return hits.select("id", "section", F.lit("revision").alias("kind")).unionByName(found.select("id", F.lit("").alias("section"), F.lit("message").alias("kind")))


_FNS = (indexed_search, indexed_documents, indexed_history)
QUERIES = {f.__name__: f for f in _FNS}

_ASKED_SQL = ", ".join("(" + str(i) + ", '" + q.strip().lower().replace("'", "''") + "')" for i, q in enumerate(ASKED))
ORACLE_SQL = {
    "indexed_search": STATUTE_SQL["local_search"],
    "indexed_documents": f"SELECT query_no, doc_id FROM documents, (VALUES {_ASKED_SQL}) q(query_no, q) WHERE length(q) >= 2 AND contains(lower(text), q)",
    "indexed_history": READER_SQL["change_history"],
}
