"""Lists in chunks against plain lists."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codicil.operators import history as H
from codicil.operators import lists as L


@pytest.fixture(scope="module")
def rows():
    """A hot list, short ones, one without a key, repeats and ties, null and empty elements."""
    dealt = random.Random(2)
    keys = ["hot"] * 900 + ["a", "b", None] * 60
    elements = lambda: dealt.choice([f"note {dealt.randrange(400)}", "x", "", None, "é; ü"])
    return [(k, elements(), dealt.randrange(80), i // 2) for i, k in enumerate(dealt.sample(keys, len(keys)))]


def plain(rows, distinct):
    found = collections.defaultdict(list)
    for k, e, a, b in sorted((r for r in rows if r[1]), key=lambda r: (r[2], r[3], r[1])):
        if not distinct or e not in found[k]:
            found[k].append(e)
    return dict(found)


@pytest.mark.parametrize("distinct", [True, False])
def test_lists_in_chunks(spark, rows, distinct):
    d = spark.createDataFrame(rows, "section string, note string, a long, b long")
    want = plain(rows, distinct)
    ranks = L.ranked(d.repartition(5), "section", "note", ["a", "b"], distinct).collect()
    got = collections.defaultdict(dict)
    for r in ranks:
        got[r.section][r["rank"]] = r.note
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want and sum(map(len, want.values())) == len(ranks)
    pieces = L.listed(d, "section", F.col("note"), ["a", "b"], distinct, size=7)
    held = collections.Counter()
    for r in pieces.collect():
        held[r.section] += 1
        assert r.text == "; ".join(want[r.section][7 * r.chunk : 7 * r.chunk + 7])
    assert held == {k: -(-len(v) // 7) for k, v in want.items()}
    whole = {r.section: r.text for r in L.texts(pieces, "section").collect()}
    assert whole == {k: "; ".join(v) for k, v in want.items()}
    assert {tuple(r) for r in L.digests(pieces, "section").collect()} == {(k, hashlib.md5(v.encode()).hexdigest(), len(v)) for k, v in whole.items()}


def test_no_rows(spark, rows):
    d = spark.createDataFrame(rows, "section string, note string, a long, b long").limit(0)
    assert L.digests(L.listed(d, "section", F.col("note"), ["a", "b"]), "section").count() == 0


def test_back_fill_takes_lists_of_unresolved_notes_only(spark):
    ops = spark.createDataFrame([("Ord", "omitted", "clause (a)", "5a", "page 3", 2, 1), ("Ord", "omitted", "clause (a)", "5A", "page 3", 3, 1), ("Act", "inserted", "", "5A", "", 1, 1)], "title string, operation string, target string, principal_section string, page_reference string, doc_ord long, op_ord long")
    notes = spark.createDataFrame([(1, "5a", H.UNRESOLVED), (2, "5A", "resolved"), (3, "9", H.UNRESOLVED), (4, None, None)], "id long, section string, note string")
    filled, lists = H.back_fill(notes, ops)
    assert filled.columns == ["id", "section", "note", "note_list"]
    assert {r.id: r.note_list for r in filled.collect()} == {1: "5A", 2: None, 3: None, 4: None}
    (text,) = L.texts(lists, "section").collect()
    assert text == ("5A", "Act: inserted (section 5A); Ord: omitted clause (a) (section 5a, page 3); Ord: omitted clause (a) (section 5A, page 3)")
