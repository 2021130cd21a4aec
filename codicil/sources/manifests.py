"""Manifests of downloads: CSV files below a root, each with a header of its own."""

from __future__ import annotations

import csv
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.text import squeeze

ROWS = "manifest string, seq long, fields map<string,string>"
#: Headers differ from harvester to harvester, not from file to file.
MOST_HEADERS = 1000


def plain_path(path: Column) -> Column:
    """A path as scans of binary files give it, with local files spelt one way."""
    return F.regexp_replace(path, "^file:/+", "/")


def _own_path() -> Column:
    """The path of the file that a row is from; unlike other paths, this column of Spark's has percent signs."""
    return plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def resolved(manifest: Column, name: Column) -> Column:
    """The path of a name that a manifest gives: relative to its folder unless absolute, without . and .. parts."""
    store = F.regexp_extract(manifest, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    folder = F.regexp_replace(F.substr(manifest, F.length(store) + 1), "/[^/]*$", "")
    parts = F.split(F.when(name.startswith("/"), name).otherwise(F.concat(folder, F.lit("/"), name)), "/")
    empty = F.array().cast("array<string>")
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.concat(store, F.lit("/"), F.array_join(F.aggregate(parts, empty, step), "/"))


def _headers(spark: SparkSession, root: str, name: str) -> dict[str, list[str]]:
    """The files of each header line.  Files with bytes that are no UTF-8 are unreadable and left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    lines = lines.select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    whole = F.bool_and(F.is_valid_utf8("value")).alias("readable")
    first = F.min_by(F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("value")), F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("at")))
    files = defaultdict(list)
    for r in lines.groupBy("file").agg(whole, first.alias("header")).filter("readable AND header IS NOT NULL").orderBy("file").toLocalIterator():
        files[r["header"]].append(r["file"])
        if len(files) > MOST_HEADERS:
            raise ValueError(f"over {MOST_HEADERS} different headers below {root}: are these manifests?")
    return files


def scan_manifests(spark: SparkSession, root: str, name: str = "downloads.csv") -> DataFrame:
    """(manifest, seq, fields) of every row of the files of a name below a root: the file, an order of its rows, and a map from
    its own header's names to the values, so that files may have any columns in any order.

    Values may be quoted and hold line ends.  A short row lacks its last fields; of two columns of one name the later counts.
    A missing root, one without such files, empty files and files that are not UTF-8 give no rows.
    The listing and one header a file go through the driver, as with any scan; rows do not.
    """
    try:
        files = _headers(spark, root, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = {}
    rows = spark.createDataFrame([], ROWS)
    for header, paths in files.items():
        (names,) = csv.reader([header.removeprefix("\ufeff")])
        last = {n: i for i, n in enumerate(names)}
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        # with multiLine one task reads a file from its start to its end, so ids ascend within a file
        d = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").csv([_unquoted(p) for p in paths])
        fields = F.create_map(*[x for n, i in last.items() for x in (F.lit(n), F.col(f"c{i}"))])
        rows = rows.unionByName(d.select(_own_path().alias("manifest"), F.monotonically_increasing_id().alias("seq"), F.map_filter(fields, lambda _, v: v.isNotNull()).alias("fields")))
    return rows


def _unquoted(path: str) -> str:
    """A file's path as read() takes it: without percent signs, and with glob characters escaped."""
    from urllib.parse import unquote

    return "".join("\\" + c if c in "*?[]{}\\" else c for c in unquote(path))


def latest_ids(manifests: DataFrame, name: str = "saved_filename", document_id: str = "document_id") -> DataFrame:
    """(filename, document_id, seq) of scan_manifests(): each file's resolved path and its id.

    The later row wins, by manifest and then place in it; rows without a name or an id drop out.
    """
    field = lambda c: squeeze(F.coalesce(F.col("fields")[c], F.lit("")))
    d = manifests.select("manifest", "seq", field(name).alias("name"), field(document_id).alias("document_id")).filter("name <> '' AND document_id <> ''")
    last = d.groupBy(resolved(F.col("manifest"), F.col("name")).alias("filename")).agg(F.max_by(F.struct("document_id", "seq"), F.struct("manifest", "seq")).alias("last"))
    return last.select("filename", "last.document_id", "last.seq")
