"""Merging parsed fragments of a statute: ordered keyed merges, stitching, gates and reading order.

Rows are flat: one per clause fragment, with batch order and place (`ord`) explicit, since results depend on
which fragment came first.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codicil.functions import text as X

#: Longest overlap of two fragments that is looked for, in words, and the shortest that counts.
MOST_OVERLAP, LEAST_OVERLAP = 250, 3


def cuts(words: Column, step: int, most: int) -> Column:
    """array of texts: up to `most` words from every `step` words on; the words are worked out once."""
    starts = lambda w: F.sequence(F.lit(0), F.floor(F.size(w) / step).cast("int"))
    return X.let(words, lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i * step + 1, most), " ")))


def stitch(a: str, b: str) -> str:
    """Two fragments without double blanks as one text: the one that holds the other, or both joined over their longest overlap.

    The overlap is the longest run of words that ends one and starts the other, the first fragment's end being
    tried first at each length; without one they are put side by side.
    """
    if not a or not b:
        return a or b
    if a in b or b in a:
        return b if a in b else a
    a_first, a_last, b_first, b_last = _first(a), _last(a), _first(b), _last(b)
    for k in range(min(len(a_first), len(b_first)), LEAST_OVERLAP - 1, -1):
        if a_last[-k] == b_first[0] and a_last[-k:] == b_first[:k]:
            return a + b[len(" ".join(b_first[:k])) :]
        if b_last[-k] == a_first[0] and b_last[-k:] == a_first[:k]:
            return b + a[len(" ".join(a_first[:k])) :]
    return f"{a} {b}"


def _first(text: str) -> list[str]:
    return text.split(" ", MOST_OVERLAP)[:MOST_OVERLAP]


def _last(text: str) -> list[str]:
    return text.rsplit(" ", MOST_OVERLAP)[-MOST_OVERLAP:]


@F.pandas_udf(StringType())
def _folded(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: reduce(stitch, p))


def stitched(text: Column, *order: Column) -> Column:
    """Aggregate: fragments of a group stitched in their order, from the first on.

    The fold is not associative, so a group's fragments meet in one row; groups are single provisions.  Blanks are
    squeezed once a fragment, and the fold looks at the ends of what it has so far.  Group by a column: Spark cannot
    plan a Python function over an aggregate whose key is a constant.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))), lambda x: x["_text"])
    return _folded(F.when(F.size(parts) > 1, F.transform(parts, X.squeeze)).otherwise(F.transform(parts, lambda x: F.coalesce(x, F.lit("")))))


def first_change(status: Column, order: Column) -> Column:
    """Aggregate: the first status other than active, else active."""
    changed = F.when(status != "active", status)
    return F.coalesce(F.min_by(changed, F.when(changed.isNotNull(), order)), F.lit("active"))


def longest(title: Column, order: Column) -> Column:
    """Aggregate: the longest title, the earliest of equals."""
    return F.max_by(title, F.struct(F.length(title), -order))


def key(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def real_chapter(chapter_no: Column) -> Column:
    return ~key(chapter_no).isin("", "N/A")


def merge_chapters(fragments: DataFrame) -> DataFrame:
    """(chapter, chapter_title, position, n_fragments); fragments of unnamed chapters are not merged."""
    f = fragments.filter(real_chapter(F.col("chapter_no"))).withColumn("chapter", key(F.col("chapter_no")))
    return f.groupBy("chapter").agg(longest(F.col("chapter_title"), F.col("ord")).alias("chapter_title"), F.min("ord").alias("position"), F.count("*").alias("n_fragments"))


def dropped_fragments(fragments: DataFrame) -> DataFrame:
    """What merge_chapters() leaves out, for all to see."""
    return fragments.filter(~real_chapter(F.col("chapter_no")))


def merge_sections(fragments: DataFrame) -> DataFrame:
    """(chapter, section, title, status, position): fragments of a chapter's section merged."""
    f = fragments.filter(real_chapter(F.col("chapter_no"))).withColumn("chapter", key(F.col("chapter_no"))).withColumn("section", F.upper("section_no"))
    return f.groupBy("chapter", "section").agg(
        longest(F.col("title"), F.col("ord")).alias("title"), first_change(F.col("section_status"), F.col("ord")).alias("status"), F.min("ord").alias("position")
    )


def place_sections_once(fragments: DataFrame) -> DataFrame:
    """fragments with a section's chapter being that of its first fragment; blank numbers stay as they are.

    One shuffle by section.  If the first fragment is in an unnamed chapter, merging drops the whole section.
    """
    f = fragments.withColumn("section_no", X.repair_section_number(F.col("section_no")))
    first = Window.partitionBy(F.upper("section_no"), F.when(F.trim("section_no") == "", F.col("ord"))).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return f.withColumn("chapter_no", F.first("chapter_no").over(first)).withColumn("chapter_title", F.first("chapter_title").over(first))


def merge_subsections(fragments: DataFrame) -> DataFrame:
    """(chapter, section, subsection, status, position, n_clauses)."""
    f = fragments.filter(real_chapter(F.col("chapter_no"))).select("*", key(F.col("chapter_no")).alias("chapter"), F.upper("section_no").alias("section"), F.upper("subsection_no").alias("subsection"))
    return f.groupBy("chapter", "section", "subsection").agg(
        first_change(F.col("sub_status"), F.col("ord")).alias("status"), F.min("ord").alias("position"), F.count_distinct(F.upper("clause_no")).alias("n_clauses")
    )


def merge_clauses(fragments: DataFrame) -> DataFrame:
    """(chapter, section, subsection, clause, text, position): texts stitched in order."""
    f = fragments.filter(real_chapter(F.col("chapter_no"))).select("*", key(F.col("chapter_no")).alias("chapter"), F.upper("section_no").alias("section"), F.upper("subsection_no").alias("subsection"), F.upper("clause_no").alias("clause"))
    return f.groupBy("chapter", "section", "subsection", "clause").agg(stitched(F.col("text"), F.col("ord")).alias("text"), F.min("ord").alias("position"))


def distinct_notes(notes: DataFrame, *path: str) -> DataFrame:
    """The first note of each reference and wording below a path, in order."""
    w = Window.partitionBy(*path, F.coalesce("footnote_ref", F.lit("")), X.squeeze(F.col("note"))).orderBy("ord")
    return notes.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def richest_chapters(instances: DataFrame, score: Column) -> DataFrame:
    """(chapter, instance, score, position): of each chapter's instances that with the highest score, the first of equals.

    instances: rows (chapter_no, instance, …); score: an aggregate over an instance's rows.
    """
    scored = instances.groupBy(key(F.col("chapter_no")).alias("chapter"), "instance").agg(score.alias("score"))
    return scored.groupBy("chapter").agg(
        F.max_by("instance", F.struct("score", -F.col("instance"))).alias("instance"), F.max("score").alias("score"), F.min("instance").alias("position")
    )


def heading_artefacts(subsections: DataFrame) -> DataFrame:
    """subsections (section, title, subsection, text, n_clauses, n_notes) without artefacts of overlap.

    A sole unnumbered subsection of under 10 characters without clauses comes from a table of contents; among
    two or more, an unnumbered one without clauses and notes whose text is the heading repeats the heading.
    """
    w = Window.partitionBy("section")
    bare = (key(F.col("subsection")) == "N/A") & (F.col("n_clauses") == 0)
    n = F.count("*").over(w)
    contents = bare & (n == 1) & (F.length("text") < 10)
    repeats = bare & (n >= 2) & (F.col("n_notes") == 0) & (X.heading_key(F.col("text"), F.col("section")) == X.heading_key(F.col("title"), F.col("section")))
    return subsections.withColumn("_drop", contents | repeats).filter("NOT _drop").drop("_drop")


def act_violations(sections: DataFrame, least_chapters: int = 20, least_sections: int = 400) -> DataFrame:
    """(rule, detail, n): what is wrong with a merged act (chapter, section); no rows if nothing is."""
    totals = sections.agg(F.count_distinct("chapter").alias("c"), F.count("*").alias("s"))
    few = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("chapters").alias("rule"), F.lit("").alias("detail"), F.col("c").alias("n"), (F.col("c") < least_chapters).alias("bad")),
                F.struct(F.lit("sections").alias("rule"), F.lit("").alias("detail"), F.col("s").alias("n"), (F.col("s") < least_sections).alias("bad")),
            )
        ).alias("x")
    ).select("x.*")
    numbers = sections.groupBy(F.upper("section").alias("detail")).agg(F.count("*").alias("n"))
    invalid = numbers.filter(~F.col("detail").rlike("^[0-9]+[A-Z]*$")).select(F.lit("number").alias("rule"), "detail", "n")
    twice = numbers.filter("n > 1").select(F.lit("duplicate").alias("rule"), "detail", "n")
    return few.filter("bad").drop("bad").unionByName(invalid).unionByName(twice)


def carried_identity(headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """headings (doc, batch, chapter_no, chapter_title, section_no, title) with what came before each batch."""
    before = Window.partitionBy(doc).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    named = real_chapter(F.col("chapter_no"))
    chapter = F.when(named, F.concat(F.lit("CHAPTER "), F.col("chapter_no"), F.lit(" ("), F.col("chapter_title"), F.lit(")")))
    section = F.when(F.col("section_no") != "", F.concat(F.lit("section "), F.col("section_no"), F.lit(" ("), F.col("title"), F.lit(")")))
    unknown = F.lit("not yet established")
    return headings.withColumn("carried_chapter", F.coalesce(F.last(chapter, True).over(before), unknown)).withColumn("carried_section", F.coalesce(F.last(section, True).over(before), unknown))


def heading_paths(lines: DataFrame, chapter: str, section: str, doc: str = "doc_id") -> DataFrame:
    """lines (doc, line, text) with the last chapter and section heading at or above each."""
    above = Window.partitionBy(doc).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    is_chapter, is_section = F.col("text").rlike(chapter), F.col("text").rlike(section)
    with_chapter = lines.withColumn("chapter_line", F.last(F.when(is_chapter, F.col("line")), True).over(above))
    return with_chapter.withColumn("section_line", F.last(F.when(is_section, F.col("line")), True).over(above)).withColumn(
        "section_line", F.when(F.col("section_line") >= F.coalesce("chapter_line", F.lit(-1)), F.col("section_line"))
    )


def reading_order(sections: DataFrame, reach: int = 5) -> DataFrame:
    """sections (chapter, section, position) with the previous and next one and those within reach."""
    w = Window.partitionBy("document").orderBy("position")
    near = w.rowsBetween(-reach, reach)
    return sections.select("*", F.lag("section").over(w).alias("previous"), F.lead("section").over(w).alias("next"), F.array_join(F.collect_list("section").over(near), ",").alias("near"))


def chapter_ranges(sections: DataFrame) -> DataFrame:
    """(chapter, section_range): first to last section by position; a single one alone."""
    first, last = F.min_by("section", "position"), F.max_by("section", "position")
    return sections.groupBy("chapter").agg(F.when(F.count("section") == 0, "").when(F.count("section") == 1, first).otherwise(F.concat(first, F.lit(" to "), last)).alias("section_range"))


# Segmentation of plain text -------------------------------------------------------------------------------

# What marks a clause, a subsection, a footnote and a chapter.
CLAUSE = r"(?i)\((?:[a-z]\)|[i|v|x]+\))"
SUBSECTION = r"(?i)\((?<!sub-section\s\()(?<!sub-sections\s\()(?<!section\s\()[0-9]+[A-Z]?\)"
FOOTNOTE = r"(?m)^\s*+([0-9]++)\.\s++(.*?(?:w\.e\.f\.|Act\s+[0-9]+).*)"
CHAPTER = r"CHAPTER\s+[IVXLCDM0-9]+\s*\n+[^\n]+"


def between_markers(text: Column, marker: str) -> Column:
    """array<struct<mark, content>>: each marker with what stands between it and the next one, without blanks before it.

    Markers are listed and the text is cut at them, so that the time grows with the text, however far apart they are.
    """
    contents = X.let(F.split(text, marker, -1), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))
    return F.zip_with(F.regexp_extract_all(text, F.lit(marker), F.lit(0)), contents, lambda m, c: F.struct(m.alias("mark"), F.regexp_replace(c, r"\A\s+", "").alias("content")))


def footnotes(text: Column) -> Column:
    """array<struct<ref, note>> of footnote lines; the text is searched once, and each line taken apart."""
    part = lambda line, n: F.regexp_extract(line, r"(?s)\A\s*([0-9]+)\.\s+(.*)\z", n)
    return F.transform(F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(0)), lambda x: F.struct(part(x, 1).alias("ref"), F.trim(F.regexp_replace(part(x, 2), r"\s+", " ")).alias("note")))


def without_footnotes(text: Column) -> Column:
    return F.regexp_replace(text, FOOTNOTE, "")


def linked_notes(text: Column, notes: Column) -> Column:
    """Those of the footnotes that a text refers to by `N***`, `N[` or `[N`."""
    some = F.contains(text, F.lit("[")) | F.contains(text, F.lit("***"))
    linked = F.filter(notes, lambda n: F.contains(text, F.concat(n["ref"], F.lit("***"))) | F.contains(text, F.concat(n["ref"], F.lit("["))) | F.contains(text, F.concat(F.lit("["), n["ref"])))
    return F.when(some, linked).otherwise(F.slice(notes, 1, 0))


def wording_status(text: Column, numbered: Column) -> Column:
    has = lambda low, word: F.contains(low, F.lit(word))
    return X.let(F.lower(text), lambda low: F.when(has(low, "omitted"), "omitted").when(has(low, "substituted") | (numbered & has(low, "subs.")), "substituted").otherwise("active"))


def segment_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, chapter, chapter_title, section, title, body) from plain text.

    A chapter is `CHAPTER n` and its title's line; a section starts at a line `N. `; its title ends at the first
    dash.  A text without chapters is one chapter N/A, General.
    """
    text = F.coalesce("text", F.lit(""))
    named = lambda body: F.filter(F.split(body, rf"(?={CHAPTER})"), lambda p: p.rlike(rf"\A{CHAPTER}"))
    chapters = X.let(without_footnotes(text), lambda body: X.let(named(body), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(body))))
    # footnotes are listed before chapters become rows, so once a text; no list below is empty, and an outer
    # explode keeps Spark from making it a second time for a filter on its size
    d = docs.select("doc_id", footnotes(text).alias("notes"), chapters.alias("_chapters")).select("doc_id", "notes", F.posexplode_outer("_chapters").alias("chapter_ord", "part"))
    d = d.withColumn("head", F.regexp_extract("part", rf"\A({CHAPTER})", 1)).withColumn("part", F.expr("substring(part, length(head) + 1)"))
    d = d.withColumn("chapter", F.when(F.col("head") == "", "N/A").otherwise(F.regexp_extract("head", r"(CHAPTER\s+[IVXLCDM0-9]+)", 1)))
    d = d.withColumn("chapter_title", F.when(F.col("head") == "", "General").otherwise(X.sanitize(F.regexp_extract("head", r"\n+([^\n]+)\z", 1))))
    d = d.select("*", F.posexplode_outer(F.split("part", r"\n(?=[0-9]+[A-Z]?\.\s)")).alias("section_ord", "raw")).filter("section_ord > 0")
    d = d.withColumn("section", F.regexp_extract("raw", r"\A([0-9]+[A-Z]?)\.", 1)).withColumn("raw", F.regexp_replace(F.trim("raw"), r"\A[0-9]+[A-Z]?\.\s*", ""))
    first = F.split("raw", "\n", 2)[0]
    rest = F.when(F.instr("raw", "\n") > 0, F.expr("substring(raw, instr(raw, '\n'))")).otherwise("")
    dashed = F.split(first, "[—-]", 2)
    return d.select(
        "doc_id", "chapter_ord", "chapter", "chapter_title", "section_ord", "section", X.sanitize(dashed[0]).alias("title"),
        F.concat(F.coalesce(F.trim(F.get(dashed, F.lit(1))), F.lit("")), rest).alias("body"), "notes",
    )


def segment_subsections(sections: DataFrame) -> DataFrame:
    """sections with subsection, text, sub_status, clauses and notes; an unnumbered body is one N/A subsection."""
    sub = lambda number, content, numbered: F.struct(number.alias("subsection"), content.alias("content"), F.lit(numbered).alias("numbered"))
    marked = lambda m: F.transform(m, lambda x: sub(x["mark"], F.trim(x["content"]), True))
    parts = lambda clean: X.let(between_markers(clean, SUBSECTION), lambda m: F.when(F.size(m) > 0, marked(m)).otherwise(F.array(sub(F.lit("N/A"), clean, False))))
    d = sections.select("*", F.posexplode_outer(X.let(X.sanitize(F.col("body")), parts)).alias("sub_ord", "s")).select("*", "s.*").drop("s")
    d = d.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("content", r"\A\[", ""), r"\]\z", "")))
    clauses = F.transform(between_markers(F.col("text"), CLAUSE), lambda x: F.struct(x["mark"].alias("clause"), F.trim(F.regexp_replace(X.sanitize(x["content"]), r"\[\z", "")).alias("text")))
    d = d.withColumn("clauses", F.filter(clauses, lambda c: c["text"] != "")).withColumn("sub_status", wording_status(F.col("text"), F.col("numbered")))
    d = d.withColumn("notes", linked_notes(F.when(F.col("numbered"), F.col("content")).otherwise(F.col("body")), F.col("notes")))
    lead = F.trim(F.substring(F.col("text"), F.lit(1), F.position(F.get("clauses", F.lit(0))["clause"], F.col("text")) - 1))
    return d.withColumn("text", F.when((F.size("clauses") > 0) & (lead != ""), lead).otherwise(F.col("text"))).drop("content", "numbered")
