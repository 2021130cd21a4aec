"""Posting lists against a plain search of all texts."""

import random

from pyspark.sql import functions as F

from codicil.operators import reader as R
from codicil.operators import search_index as I
from codicil.plans import search_queries, statute_queries


def built(spark, tmp_path, rows, name="index"):
    path = f"file://{tmp_path}/{name}"
    I.write_index(spark.createDataFrame(rows, "doc long, text string, position int"), path)
    return path


def plain(rows, query):
    q = query.strip().lower()
    return sorted(d for d, t, _ in rows if len(q) >= 2 and q in (t or "").lower())


def found(spark, path, query):
    return sorted(r.doc for r in I.find(spark, path, query).collect())


def test_same_hits_as_a_plain_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 5)
    monkeypatch.setattr(I, "TEXTS_PER_LIST", 7)
    monkeypatch.setattr(I, "TEXTS_PER_FOLDER", 11)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abAB \n.é𝒳") for _ in range(rng.randrange(40))), i) for i in range(200)]
    rows += [(500, None, 0), (501, "", 1), (502, "ab", 2), (503, "xab", 3), (502, "other ab", 4), (502, "none", 5)]
    path = built(spark, tmp_path, rows)
    texts = [t for _, t, _ in rows if t and len(t) > 6]
    asked = ["ab", "b", "", " ab ", "é𝒳", "zz", "A b", "a.b", "%_", "\\"] + [t[k : k + n] for t, k, n in ((rng.choice(texts), rng.randrange(3), rng.choice([2, 3, 4, 9])) for _ in range(6))]
    for q in asked:
        assert found(spark, path, q) == plain(rows, q), q


def test_long_texts_and_long_queries(spark, tmp_path):
    long = "".join(f"clause {i} of many; " for i in range(20_000))
    rows = [(1, long, 1), (2, long[:-9] + "an end.", 2), (3, "clause 5 of many", 3)]
    path = built(spark, tmp_path, rows)
    for q in ("clause 19998 of many; clause 19999", "an end.", long[1000:3000], long[1000:3000] + "no"):
        assert found(spark, path, q) == plain(rows, q)


def test_first_hits_in_order_and_empty_tables(spark, tmp_path):
    rows = [(i, "some text", 100 - i) for i in range(20)]
    path = built(spark, tmp_path, rows)
    assert [r.doc for r in I.search(spark, path, "TEXT").collect()] == [19, 18, 17, 16, 15, 14]
    nothing = built(spark, tmp_path, [], "nothing")
    assert found(spark, nothing, "text") == []


def test_only_candidates_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "TEXTS_PER_FOLDER", 10)
    path = built(spark, tmp_path, [(i, f"text number {i}", i) for i in range(300)])
    d = I.find(spark, path, "number 217")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and [r.doc for r in d.collect()] == [217]
    lists = spark.read.parquet(f"{path}/postings").filter(F.col("gram") == "217")
    assert "EqualTo(gram,217)" in lists._jdf.queryExecution().executedPlan().toString()
    assert [r.doc for r in I.candidates(spark, path, "number 217").collect()] == [217]


def test_lists_are_whole_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 5)
    monkeypatch.setattr(I, "TEXTS_PER_LIST", 7)
    d = I.postings(spark.createDataFrame([(i, f"text number {i} of some") for i in range(100)], "doc long, text string").repartition(3), "doc", "text")
    assert "Exchange hashpartitioning(gram" not in d._jdf.queryExecution().executedPlan().toString()
    rows = d.collect()
    assert len({(r.gram, r.list) for r in rows}) == len(rows) and all(len(r.docs) <= 7 and r.docs == sorted(set(r.docs)) for r in rows)
    assert sorted(x for r in rows if r.gram == "mbe" for x in r.docs) == list(range(100))


def test_parts_of_sections_against_their_whole_text(spark, tmp_path, monkeypatch):
    """Numbers and texts that are null or empty, ties, queries within a part, over two and over many."""
    monkeypatch.setattr(R, "PART_ROWS", 5)
    monkeypatch.setattr(R, "MORE_ROWS", 2)
    dealt = random.Random(4)
    one = dealt.choice
    rows = [(one(["I", "i ", "II", "N/A", None, ""]), one(["1a", "1A", "2", None, ""]), [None, "", "C"][o % 3 if o else 0], ["title", None, ""][o % 5 % 3 if o else 1], one(["", "(1)", None]), one(["(a)", "", None]), one(["text", "Ab c", "é𝒳", "", None, "ΟΔΟΣ"]), one(["", "note", None]), o) for o in [one([i, i // 3, None]) for i in range(400)]]
    fragments = spark.createDataFrame(rows + [("III", "9", "c", "t", "", None, "", "", 1)], "chapter_no string, section_no string, chapter_title string, title string, subsection_no string, clause_no string, text string, note string, ord long")
    parts = R.search_parts(fragments).withColumn("doc", F.xxhash64("chapter", "section", "nth"))
    got = sorted(parts.collect(), key=lambda r: r.nth)
    blobs = {(r.chapter, r.section, r.position): r.blob for r in R.search_blobs(fragments).collect()}
    assert {k: "".join(r.part[: r.own] for r in got if (r.chapter, r.section, r.position) == k) for k in blobs} == blobs and len(got) > 2 * len(blobs)
    path = f"file://{tmp_path}/parts"
    I.write_index(parts, path, text="part")
    long = max(blobs.values(), key=len)
    for q in [long[i : i + n] for i, n in ((3, 2), (16, 4), (40, 9), (29, 70), (len(long) // 2, 90))] + [long, long + "x", "a  (", " ab ", "A"]:
        want = {k for k, blob in blobs.items() if len(q.strip()) >= 2 and q.strip().lower() in blob}
        found = I.find_parts(spark, path, q, ["chapter", "section", "position"], R.PART_ROWS, R.MORE_ROWS).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want), q


def test_no_text_of_the_index_grows_with_a_section(spark, monkeypatch):
    monkeypatch.setattr(R, "PART_ROWS", 7, raising=False)
    monkeypatch.setattr(R, "MORE_ROWS", 2, raising=False)
    longest, write = [], I.write_index
    monkeypatch.setattr(I, "write_index", lambda texts, path, doc="doc", text="text": (longest.append(texts.agg(F.max(F.length(text))).first()[0]), write(texts, path, doc, text)))
    small = "/root/testdata/sf0.001"
    assert search_queries.indexed_search(spark, small).collect() == statute_queries.local_search(spark, small).collect()
    assert longest and max(longest) < 1000
