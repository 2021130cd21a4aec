"""Word differences against the whole table, and as a table function."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codicil.operators import reader as R


def plain(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            step = ("same", a[i])
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and t[i + 1][j] >= t[i][j + 1]):
            step, i = ("removed", a[i]), i + 1
        else:
            step, j = ("added", b[j]), j + 1
        out = [*out[:-1], (step[0], out[-1][1] + step[1])] if out and out[-1][0] == step[0] else [*out, step]
    return out


def test_both_ways_follow_the_tie_rule():
    dealt = random.Random(3)
    for _ in range(1500):
        letters = dealt.choice(["ab", "abcd", "abcdefghij"])
        a, b = ([dealt.choice(letters) for _ in range(dealt.randrange(14))] for _ in range(2))
        assert R.word_diff_operations(a, b) == plain(a, b) == R._by_table(a, b, *R._codes(a, b))
    for _ in range(30):
        a = [dealt.choice("abcdefgh") for _ in range(150)]
        b = list(a)
        for _ in range(dealt.randrange(12)):
            at = dealt.randrange(len(b))
            b[at : at + dealt.randrange(3)] = [dealt.choice("abcdefgh") for _ in range(dealt.randrange(3))]
        assert R.word_diff_operations(a, b) == plain(a, b)


def test_near_copies_take_a_tenth_of_the_tables_time():
    dealt = random.Random(4)
    a = [str(dealt.randrange(3000)) for _ in range(12000)]
    b = list(a)
    for _ in range(60):
        b[dealt.randrange(len(b))] = "new"
    start = time.perf_counter()
    got = R.word_diff_operations(a, b)
    middle = time.perf_counter()
    assert got == R._by_table(a, b, *R._codes(a, b))
    assert 10 * (middle - start) < time.perf_counter() - middle


def test_table_function(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.regexp_replace("text", "(?m)^([A-Z][a-z]+) ", "$1, indeed, ").alias("new"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "n ew"), (-3, "one, two", None), (-4, "x", "x")], "doc_id long, text string, new string")
    pairs = docs.unionByName(odd)
    rows = {}
    for r in R.word_diff_rows(pairs, "text", "new").orderBy("doc_id", "op_ord").collect():
        assert r.op_ord == len(rows.setdefault(r.doc_id, []))
        rows[r.doc_id].append((r.type, r.value))
    arrays = {r.doc_id: [tuple(x) for x in r.diff] for r in R.word_diff(pairs, "text", "new").collect() if r.diff}
    assert rows == arrays and rows[-2] == [("added", "n ew")] and rows[-3] == [("removed", "one, two")] and -1 not in rows
    spark.udtf.register("word_diff", R.WordDiff)
    pairs.filter("doc_id < 0").selectExpr("doc_id", "split(text, '') AS a", "split(new, '') AS b").createOrReplaceTempView("word_pairs")
    assert spark.sql("SELECT doc_id, type, value FROM word_pairs, LATERAL word_diff(a, b) WHERE doc_id = -4").collect() == [(-4, "same", "x")]


def test_query_keeps_both_texts_whole(spark):
    from codicil.plans import reader_queries as Q

    assert Q.near_copy_diff(spark, "/root/testdata/sf0.001").filter("NOT (old_whole AND new_whole)").count() == 0


def test_many_additions_alone_take_a_time_that_grows_with_the_texts(monkeypatch):
    """A list within the other is told in one way through; the search over all edits would take their square."""
    old = [f"w{k % 97}" for k in range(4000)]
    new = [t for k, w in enumerate(old) for t in ([w, ",", "indeed"] if k % 4 == 0 else [w])]
    by_table = R._by_table(old, new, *R._codes(old, new)), R._by_table(new, old, *R._codes(new, old))
    monkeypatch.setattr(R, "_reaches", lambda *_: pytest.fail("searched"))
    assert R.word_diff_operations(old, new) == by_table[0]
    assert R.word_diff_operations(new, old) == by_table[1]
    assert R.word_diff_operations([], ["a"]) == [("added", "a")] and R.word_diff_operations(["a"], []) == [("removed", "a")]


def test_slow_rows_of_one_file_are_dealt_over_all_cores(spark):
    from codicil.sources.tables import spread

    d = spread(spark.range(10, numPartitions=1))
    assert d.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and d.count() == 10
