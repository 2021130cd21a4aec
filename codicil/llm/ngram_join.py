"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets form one class of copies.  Classes that share a MinHash band are compared
value by value, a few at a time, and a pair is dropped once the posterior probability of reaching the
threshold falls below the tolerance.  What stays is verified exactly on the shingle sets.  Links are counted
and joined to components block by block, so no list of all pairs is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm import similar as S
from codicil.llm.common import cut, dealt_anew, documents

HASHES = 128
BANDS, ROWS = 25, 5  # pairs at similarity 0.8 share a band with a probability of 0.99995
TOLERANCE = 1e-5
#: Rows of a block when only signatures are compared, and when shingle sets are at hand.
SIGNATURE_BLOCK, SET_BLOCK = 1024, 256
#: About so many shingles are in a block of shingle sets at most, a single longer text aside.
BLOCK_SHINGLES = 200_000
#: Shingles that are hashed in one go.
BATCH_SHINGLES = 16_384

_SHORT = np.uint32(0x9E3779B1)


def row_key() -> Column:
    """What tells rows apart when a text is fetched: equal rows alone have equal keys, but for chance."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, id, n, bands, signature): a row for each document; id is of its set of n shingles."""

    def rows(batches):
        for b in batches:
            at, sets, total = 0, [], 0
            for i, s in enumerate(S.shingle_sets(b.column(2))):
                sets.append(s)
                total += len(sets[-1])
                if total >= BATCH_SHINGLES or i == b.num_rows - 1:
                    yield of(b.slice(at, len(sets)), sets)
                    at, sets, total = i + 1, [], 0

    def of(b, sets):
        n = np.array([len(s) for s in sets])
        minima = np.zeros((HASHES, len(sets)), np.uint32)
        if full := np.flatnonzero(n).tolist():
            minima[:, full] = S.minhash(np.concatenate([sets[i] for i in full]), HASHES, np.cumsum(n[full]) - n[full])
        short = np.ascontiguousarray((minima * _SHORT >> np.uint32(16)).astype("<u2").T)
        columns = [pa.array(map(S.set_id, sets), pa.binary()), pa.array(n, pa.int64()), S.list_array(S.band_keys(minima, BANDS, ROWS), pa.int64()), pa.array([x.tobytes() for x in short], pa.binary())]
        return pa.RecordBatch.from_arrays([*b.columns[:2], *columns], names=["doc_id", "key", "id", "n", "bands", "signature"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return d.mapInArrow(rows, "doc_id long, key long, id binary, n long, bands array<long>, signature binary")


def likely_edges(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """A forest of the pairs that the Bayesian test leaves, from rows (bucket, bi, bj, mine, id, signature)."""

    def rows(batches):
        a, b = [], []
        for group in S.block_groups(batches, 3):
            signature = np.frombuffer(b"".join(r[5] for r in group), "<u2").reshape(len(group), -1)
            forest = S.Forest(len(group))
            for i, others in enumerate(S.pairs_to_check(group, 1, 2, 3)):
                for j in S.still_likely(signature, i, forest.apart(i, others), threshold, tolerance):
                    if forest.join(i, int(j)):
                        a.append(group[i][4])
                        b.append(group[j][4])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return blocks.select("bucket", "bi", "bj", "mine", "id", "signature").mapInArrow(rows, "a binary, b binary")


def likely_blocks(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(root, bi, bj) of the pairs of blocks in which the Bayesian test leaves a pair, from rows (root, bi, bj, mine, id, signature)."""

    def rows(batches):
        out = []
        for group in S.block_groups(batches, 3):
            signature = np.frombuffer(b"".join(r[5] for r in group), "<u2").reshape(len(group), -1)
            if any(len(S.still_likely(signature, i, others, threshold, tolerance)) for i, others in enumerate(S.pairs_to_check(group, 1, 2, 3))):
                out.append(group[0][:3])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["root", "bi", "bj"])

    return blocks.select("root", "bi", "bj", "mine", "id", "signature").mapInArrow(rows, "root binary, bi int, bj int")


def verified_links(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """From rows (root, bi, bj, mine, id, copies, signature, text): edges (a, b) of a forest of the exact links,
    and rows (a, null, links) with how many documents each class is linked to."""

    def rows(batches):
        a, b, n = [], [], []
        for group in S.block_groups(batches, 3, S.shingle_sets):
            group = list({r[4]: r for r in group if S.set_id(r[7]) == r[4]}.values())
            if len(group) < 2:
                continue
            signature = np.frombuffer(b"".join(r[6] for r in group), "<u2").reshape(len(group), -1)
            copies = np.array([r[5] for r in group])
            links = np.zeros(len(group), np.int64)
            exact, forest = S.ExactJaccard([r[7] for r in group]), S.Forest(len(group))
            for i, others in enumerate(S.pairs_to_check(group, 1, 2, 3)):
                others = S.still_likely(signature, i, others, threshold, tolerance)
                if len(others):
                    others = others[exact.with_(i, others) >= threshold]
                links[i] += copies[others].sum()
                links[others] += copies[i]
                for j in forest.apart(i, others):
                    if forest.join(i, int(j)):
                        a.append(group[i][4])
                        b.append(group[j][4])
                        n.append(0)
            for i in np.flatnonzero(links):
                a.append(group[i][4])
                b.append(None)
                n.append(int(links[i]))
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])
                a, b, n = [], [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])

    return blocks.select("root", "bi", "bj", "mine", "id", "copies", "signature", "text").mapInArrow(rows, "a binary, b binary, links long")


def classes_of(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, id) of all rows, and (id, first, class_id, copies, links, key, leads) of the sets of shingles.

    key: the row_key() of the row that stands for the set; leads: whether it also stands for its class.
    """
    found = cut(signatures(docs), "signatures")
    classes = found.groupBy("id").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("key"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("n").alias("n")
    )
    classes = cut(classes, "classes")
    real = classes.filter("n > 0")
    buckets = S.shared_buckets(real.select("id", "bands")).join(real.select("id", "signature"), "id")
    likely = likely_edges(S.together(S.in_blocks(buckets, F.ceil(F.col("size") / SIGNATURE_BLOCK)), "bucket"), threshold, tolerance)
    members = S.components(likely).join(classes.select("id", "key", "n", "copies", "signature"), "id")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = cut(members.join(sizes.select(dealt_anew("root"), "blocks"), "root"), "likely")
    # signatures tell which blocks of a large component have a pair at all; texts go to those alone
    placed = S.in_blocks(members, F.col("blocks"))
    pairs = likely_blocks(S.together(placed.filter("blocks > 1"), "root"), threshold, tolerance)
    placed = placed.filter("blocks = 1").unionByName(placed.filter("blocks > 1").join(pairs, ["root", "bi", "bj"], "left_semi"))
    # one row of each set brings the text; any other with its key drops out by the id of its set
    texts = docs.select(row_key().alias("key"), "text").join(members.select("key", "id"), "key").select("id", "text").distinct()
    checked = cut(verified_links(S.together(placed.join(texts.select(dealt_anew("id"), "text"), "id"), "root"), threshold, tolerance), "links")
    roots = S.components(checked.filter("b IS NOT NULL").select("a", "b"))
    links = checked.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = classes.select("id", "first", "copies", "key").join(roots, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # a null doc_id stands for no others
    least = F.struct(F.col("first").isNull().alias("none"), "first", "key", "id")
    firsts = named.groupBy("root").agg(F.min(least).alias("least"))
    named = named.join(firsts.select(dealt_anew("root"), "least"), "root")
    return found.select("doc_id", "key", "id"), named.select("id", "first", F.col("least.first").alias("class_id"), "copies", "links", "key", (F.col("least.id") == F.col("id")).alias("leads"))


def near_duplicates(docs: DataFrame, threshold: float = S.THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) for each row of docs.

    class_id is the least doc_id of the component of linked rows; two rows are linked if the Jaccard
    similarity of their sets of 5-word shingles is at least the threshold.  n_copies: rows with an equal set,
    itself included.  n_links: rows linked to this one.  A text of fewer words is one shingle; null, empty and
    blank texts have equal empty sets and so are copies of each other.  Repeated rows count as copies, and so do
    different texts with one doc_id if they are alike.  A null doc_id never names a class of others; a class of
    such rows alone has a null class_id.  Very long texts are read whole, and compared in blocks of few texts.
    An empty table gives no rows.  Only doc_id and text are read; other columns, whatever their names, are not.
    """
    found, named = classes_of(docs, threshold, tolerance)
    out = found.select("doc_id", "id").join(named.select(dealt_anew("id"), "class_id", "copies", "links"), "id")
    return out.select("doc_id", "class_id", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = S.THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of docs of each class of near_duplicates(): of the least doc_id, nulls last; all columns as they are.

    Of rows that repeat one of them stays, also where several have no doc_id.  Null, empty and blank texts are
    one class.  Texts go through one shuffle, as the key of a row is computed where it is read.
    """
    found, named = classes_of(docs, threshold, tolerance)
    repeated = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("_again"))
    leaders = cut(named.filter("leads").select("key").join(repeated, "key", "left").select(F.col("key").alias("_of_key"), F.coalesce("_again", F.lit(False)).alias("_again")), "leaders")
    row = docs.select(row_key().alias("_of_row"), F.struct(*docs.columns).alias("_row"))
    stay = row.join(leaders, F.col("_of_row") == F.col("_of_key"))
    again = stay.filter("_again").select(dealt_anew("_of_row", "long"), "_row").dropDuplicates(["_of_row"])
    return stay.filter("NOT _again").select("_row.*").unionByName(again.select("_row.*"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
