"""Mentions found once, against a pattern for each item."""

import random
import re

from codicil.operators import history as H
from codicil.operators import mentions as M


def pattern(level, identifier):
    value = re.escape(identifier.strip().strip("()"))
    if level == "section":
        return re.compile(rf"\bsection\s+{value}\b", re.I)
    label = r"(?:sub-?clause|clause)" if level == "clause" else r"(?:sub-?section|subsection)"
    return re.compile(rf"\b{label}\s*\(\s*{value}\s*\)", re.I)


def names(target, level, section, identifier):
    if level == "section" or (level == "subsection" and identifier.upper() == "N/A"):
        return bool(re.fullmatch(rf"(?:(?:in|after|before)\s+)?section\s+{re.escape(section)}\s*", target.strip(), re.I))
    return bool(pattern(level, identifier).search(target))


def ends(target, level, identifier):
    m = pattern(level, identifier).search(target.strip(" "))
    return bool(m) and target.strip(" ")[m.end() :].strip(" ,;:-") == ""


def some_targets(seed, n):
    dealt = random.Random(seed)
    words = ["clause (a)", "Sub-clause( b )", "subclause (i)", "sub-section (1)", "Subsection ( 2A )", "clause (1)(a)", "clause (a", "section 5", "in section 5", "SECTION  7b ", "words", "to clause (x clause (a)", "preclause (a)", ",", ";", "clause ()", "sub-section (1)(a)(ii)", "clause\n(É)"]
    return ["".join(dealt.choice(["", " ", "  "]) + dealt.choice(words) for _ in range(dealt.randint(1, 4))) + dealt.choice(["", " ", " ,", " - ", " only"]) for _ in range(n)]


ITEMS = [("clause", x) for x in ("(a)", "b", "(i)", "(A)", "(1)(a)", "é", "( b )", "(x")] + [("subsection", x) for x in ("(1)", "2a", "N/A", "n/a", "(1)(a)(ii)")] + [("section", x) for x in ("5", "7B")]


def test_targets_that_name_an_item(spark):
    targets = sorted({t for t in some_targets(1, 600)} | {"section 5", "In section 7B", "after section 5 ", "section 55"})
    items = [(s, *x) for s in ("5", "7B") for x in ITEMS]
    got = M.named_targets(spark.createDataFrame(items, "section string, level string, id string"), spark.createDataFrame([(s, t) for s in ("5", "7B") for t in targets], "section string, target string"), "level", "id")
    want = {(s, level, i, t, ends(t, level, i)) for s, level, i in items for t in targets if names(t, level, s, i)}
    rows = got.collect()
    assert {(r.section, r.level, r.id, r.target, r._ends) for r in rows} == want and len(rows) == len(want) > 300


def test_local_notes(spark):
    notes = [(act, "5", sub, text, k) for k, text in enumerate(some_targets(2, 150)) for act in ("current", "enacted") for sub in (None, "(1)")]
    asked = [("section", "5", None, "5", "-"), ("subsection", "5", "N/A", "N/A", "n"), ("subsection", "5", "(1)", "(1)", "1"), ("clause", "5", "(1)", "(a)", "a"), ("clause", "5", "(2)", "b", "b")]
    n = spark.createDataFrame(notes, "act string, section string, subsection string, note string, ord long")
    got = H._local_notes(spark.createDataFrame(asked, "level string, section string, subsection string, _id string, _below string"), n).collect()
    want = {
        (level, i, text, k, sub is not None) for level, _, of, i, _ in asked for act, _, sub, text, k in notes
        if act == ("enacted" if level == "section" else "current") and sub in (None, of) and (level == "section" or i == "N/A" or pattern(level, i).search(text))
    }
    assert {(r.level, r._id, r.note, r.note_ord, r._a) for r in got} == want and len(want) > 100


def test_no_pattern_is_made_from_a_column(spark):
    items = spark.createDataFrame([("5", "clause", "(a)")], "section string, level string, id string")
    index = spark.createDataFrame([("5", 1, 1, "omitted", "clause (a)", "c")], "section string, doc_ord long, op_ord long, operation string, target string, citation string")
    plan = H.matches(items, index, "level", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE concat" not in plan and "NestedLoop" not in H.matches(items, index, "level", "id")._jdf.queryExecution().executedPlan().toString()
