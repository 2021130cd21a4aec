"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs: lines, cut further at sentence ends once they have PARAGRAPH_CHARS characters, so
that a text of one line has leaves too.  Sections are runs of leaves that end where a leaf's own hash says
so (one in SECTION_LEAVES), so an edit leaves the sections on both sides as they were.  A leaf's hash is of
its exact characters, a section's of its leaves' and the root's of its sections'.  Equal roots mean equal
texts; walking down from differing roots, only differing sections are opened and their leaves locate edits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm.common import documents

PARAGRAPH_CHARS = 48
SECTION_LEAVES = 8
_UNIT = re.compile(r"[^\n.!?]*[.!?\n]*")


def paragraphs(text: str) -> list[str]:
    """The leaves; put together they are the text."""
    leaves, start, end = [], 0, 0
    for m in _UNIT.finditer(text):
        end = m.end()
        if end - start >= PARAGRAPH_CHARS or text[end - 1 : end] == "\n":
            if end > start:
                leaves.append(text[start:end])
            start = end
    if end > start:
        leaves.append(text[start:end])
    return leaves


def _hash(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def fingerprint(text: str) -> str:
    """root|section;section... with section = hash=leaf.n,leaf.n... where n is the leaf's number of characters."""
    sections, own, root, below = [], [], hashlib.blake2b(digest_size=16), []
    leaves = paragraphs(text)
    for i, leaf in enumerate(leaves):
        h = _hash(leaf.encode("utf-8", "surrogatepass"), 16)
        below.append(h)
        own.append(f"{h[:5].hex()}.{len(leaf)}")
        if h[15] % SECTION_LEAVES == 0 or i == len(leaves) - 1:
            section = _hash(b"".join(below), 16)
            root.update(section)
            sections.append(f"{section[:6].hex()}={','.join(own)}")
            own, below = [], []
    return f"{root.hexdigest()}|{';'.join(sections)}"


def _sections(print_: str) -> Counter:
    return Counter(print_.partition("|")[2].split(";")) if print_[-1:] != "|" else Counter()


def _leaves(sections) -> Counter:
    return Counter(leaf for s, n in sections.items() for _ in range(n) for leaf in s.partition("=")[2].split(","))


def _chars(leaves: Counter) -> int:
    return sum(int(x.partition(".")[2]) * n for x, n in leaves.items())


def likeness(a: str, b: str) -> float:
    """Share of both texts' characters in leaves that they have in common, from 0 to 1; two empty texts are alike.

    Equal roots decide at once, equal sections are not opened.
    """
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    sa, sb = _sections(a), _sections(b)
    same = sa & sb
    la, lb = _leaves(sa - same), _leaves(sb - same)
    shared = _chars(_leaves(same))
    total = 2 * shared + _chars(la) + _chars(lb)
    return 2 * (shared + _chars(la & lb)) / total if total else 1.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(start, end) in code points of a's leaves that b does not have: where a was edited."""
    theirs, at, found = _leaves(_sections(b)), 0, []
    for s in filter(None, a.partition("|")[2].split(";")):
        for leaf in s.partition("=")[2].split(","):
            n = int(leaf.partition(".")[2])
            if theirs[leaf]:
                theirs[leaf] -= 1
            elif found and found[-1][1] == at:
                found[-1] = (found[-1][0], at + n)
            else:
                found.append((at, at + n))
            at += n
    return found


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: About so many rows are in a part, which one task reads in order.
ROWS_PER_PART = 100_000


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, guest, doc_id, missing, text): rows dealt by ranges of doc_id, with a guest at each range's end.

    A part's guest is the first row of the next part that has rows (of the last: the first row of all), so
    that each row's successor is in its own part.  Bounds and firsts come from the ids alone, one of each for a
    part, and there are as many parts as the number of rows asks for; the texts are dealt once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "text")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_PART))
    bounds = sorted({min(int(x), 2**63 - 1) for x in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    placed = rows.withColumn("part", _part_of(bounds)(F.col("doc_id")))
    firsts = sorted((r["part"], r["first"]) for r in placed.groupBy("part").agg(F.min("doc_id").alias("first")).collect())  # a row for each part
    # firsts[-1] leads the list around: the last part is host to the first row of all
    hosts = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "_first long, _host int")
    found = placed.join(F.broadcast(hosts), F.col("doc_id") == F.col("_first"), "left")  # no more rows than parts
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    seats = F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_host").alias("part"), F.lit(True).alias("guest"))))
    seated = found.withColumn("_seat", F.explode(seats)).select("_seat.part", "_seat.guest", "doc_id", "missing", "text")
    return seated.repartition("part").sortWithinPartitions("part", "guest", "doc_id", F.desc("missing"), "text")


def _part_of(bounds: list[int]):
    @F.pandas_udf("int")
    def part_of(ids):
        import numpy as np
        import pandas as pd

        return pd.Series(np.searchsorted(np.asarray(bounds, np.int64), ids.to_numpy(), side="right").astype("int32"))

    return part_of


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how alike they and the next row's are.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next row in
    ascending doc_id (null first, rows of equal ids by text; the last row's next is the first).  Null texts
    count as empty.  Equal rows each give a row.  A table of one row is its own next; an empty table gives no rows.
    A text of any length is held whole by its task, beside the one before.  Other columns, whatever their names,
    play no part.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(doc_id, missing, text, print_, following, next_print):
        changed = edited(text, following)
        changed_print = fingerprint(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (None if missing else doc_id, len(text), sha, print_, changed_print, likeness(print_, changed_print), likeness(print_, next_print))

    def rows(batches):
        before = None  # (part, doc_id, missing, text, fingerprint) that waits for its successor
        for b in batches:
            out = []
            for part, guest, doc_id, missing, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                text = text or ""
                if before is None or before[0] != part:
                    if guest:
                        continue  # a second row with the guest's id
                    before = (part, doc_id, missing, text, fingerprint(text))
                    continue
                print_ = fingerprint(text)
                out.append(result(*before[1:], text, print_))
                before = None if guest else (part, doc_id, missing, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, parts).mapInArrow(rows, schema)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
