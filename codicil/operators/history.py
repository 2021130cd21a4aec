"""Amendment citations, and reconciling current with enacted wording by exact citations."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from codicil.functions import text as X
from codicil.operators import lists as L
from codicil.operators.mentions import is_at_large, is_mention, named_targets, with_identifiers, with_mentions
from codicil.sources.shared import cut

#: Wordings with a similarity below this are materially different.
LEAST_ALIKE = 0.97
UNRESOLVED = "Amendment source was not identified in the parsed footnotes."


def citation(operation: Column, title: Column, act_number: Column, target: Column, excerpt: Column, page: Column, effective: Column) -> Column:
    """Operation by title (Act n), target, source item i, PDF page p; effective d. — each part only if there is one."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    part = lambda before, c, after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    item = F.coalesce(F.nullif(F.regexp_extract(text(excerpt), r"^([0-9]+[A-Z]?)\.", 1), F.lit("")), F.regexp_extract(text(excerpt), r"^(\([^)]+\))", 1))
    day = F.when(F.lower(text(effective)).isin("not specified", "n/a"), "").otherwise(text(effective))
    return F.concat(
        F.upper(F.left(operation, F.lit(1))), F.lower(F.substring(operation, 2, 1000)), F.lit(" by "), F.coalesce(title, F.lit("Companies Amendment Act")),
        part(" (Act ", text(act_number), ")"), part(", ", text(target)), part(", source item ", item), part(", PDF page ", F.regexp_replace(text(page), r"(?i)^(?:PDF\s+)?page\s+", "")),
        part("; effective ", day), F.lit("."),
    )


def ordinance_note(title: Column, operation: Column, target: Column, section: Column, page: Column) -> Column:
    part = lambda before, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c)).otherwise("")
    return F.concat(title, F.lit(": "), operation, part(" ", target), F.lit(" (section "), section, part(", ", page), F.lit(")"))


def citation_index(ops: DataFrame) -> DataFrame:
    """(section, doc_ord, op_ord, operation, target, citation) from operations: the index of sections to citations."""
    made = citation(*map(F.col, ("operation", "title", "act_number", "target", "source_excerpt", "page_reference", "effective_date")))
    return ops.select(F.upper("principal_section").alias("section"), "doc_ord", "op_ord", "operation", F.trim("target").alias("target"), made.alias("citation"))


def first_worded(ops: DataFrame) -> DataFrame:
    """Of operations that differ in their places alone the first: all that a list of different citations needs."""
    worded = ["principal_section", "operation", "title", "act_number", "target", "source_excerpt", "page_reference", "effective_date"]
    return ops.groupBy(*worded).agg(F.min(F.struct("doc_ord", "op_ord")).alias("_first")).select(*worded, "_first.doc_ord", "_first.op_ord")


def distinct_listed(rows: DataFrame, keys: list[str], note: str, order: list[str]) -> DataFrame:
    """(keys, note): each group's different notes in the order of their first occurrence, as an array."""
    first = rows.filter(F.coalesce(note, F.lit("")) != "").groupBy(*keys, note).agg(F.min(F.struct(*order)).alias("_first"))
    parts = F.array_sort(F.collect_list(F.struct("_first", note)))
    return first.groupBy(*keys).agg(F.transform(parts, lambda x: x[note]).alias(note))


def matches(items: DataFrame, index: DataFrame, level: str, identifier: str) -> DataFrame:
    """items joined with the operations of citation_index() whose target names them; _omits: by which they are removed.

    Many operations of a section have one target: a section's different targets are searched for mentions once, items
    meet those by section, level and identifier, and operations then join by section and target.
    """
    named = named_targets(items, index.select("section", "target").distinct(), level, identifier)
    return named.join(index, ["section", "target"]).withColumn("_omits", F.col("_ends") & (F.col("operation") == "omitted")).drop("_ends")


@F.pandas_udf(BooleanType())
def _unlike(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() < LEAST_ALIKE for a, b in zip(first, second, strict=True)], dtype=bool)


def materially_different(pairs: DataFrame, enacted: str, current: str) -> DataFrame:
    """Those pairs whose wordings differ materially.

    Equal, one-sidedly empty and very differently long wordings are decided by columns; only the others go
    through the sequence matcher, in batches.
    """
    d = pairs.withColumn("_a", X.comparison_key(F.col(enacted))).withColumn("_b", X.comparison_key(F.col(current))).filter("_a <> _b")
    shorter, both = F.least(F.length("_a"), F.length("_b")), F.length("_a") + F.length("_b")
    sure = (F.col("_a") == "") | (F.col("_b") == "") | (2 * shorter < LEAST_ALIKE * both)
    return d.filter(sure).unionByName(d.filter(~sure).filter(_unlike("_a", "_b"))).drop("_a", "_b")


def _keyed(p: DataFrame) -> DataFrame:
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return p.select(
        up("chapter").alias("chapter"), F.upper(F.coalesce("section", F.lit(""))).alias("section"), F.upper(F.coalesce("subsection", F.lit("N/A"))).alias("subsection"), F.lower("clause").alias("clause"), "text", "ord"
    )


def _local_notes(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """asked (level, section, subsection, _id, _below) with the notes (note, _a, note_ord) of their section, or subsection, that
    name them; all of those where an item stands for the whole section.  Sections have enacted notes, others current ones."""
    n = notes.select("act", F.upper("section").alias("_s"), F.upper("subsection").alias("_sub"), "note", F.col("ord").alias("note_ord"), F.col("subsection").isNotNull().alias("_a"))
    side = F.when(F.col("level") == "section", "enacted").otherwise("current")
    out = ["level", "section", "_id", "_below", "note", "_a", "note_ord"]
    asked = asked.withColumn("_side", side)
    wide = asked.filter(is_at_large(F.col("level"), F.col("_id")))
    wide = wide.join(n, (F.col("section") == F.col("_s")) & (F.col("act") == F.col("_side")) & (F.col("_sub").isNull() | (F.col("subsection") == F.col("_sub")))).select(*out)
    m = with_mentions(n, F.col("note")).select(F.struct("level", "_key", "_before", "_after").alias("_m"), "act", "_s", "_sub", "note", "_a", "note_ord")
    own = with_identifiers(asked.filter(~is_at_large(F.col("level"), F.col("_id"))), "level", "_id")
    named = own.join(m, is_mention() & (F.col("section") == F.col("_s")) & (F.col("act") == F.col("_side")) & (F.col("_sub").isNull() | (F.col("subsection") == F.col("_sub")))).select(*out)
    return wide.unionByName(named)


def reconcile(current: DataFrame, enacted: DataFrame, notes: DataFrame, index: DataFrame, scope: str = "chapter", shown: Callable[[Column], Column] = lambda note: note) -> DataFrame:
    """What the enacted wording adds to the current one: (level, chapter, section, subsection, clause, action, change_type, source_note, text).

    current, enacted: rows (chapter, section, subsection, clause, text, ord); clause null holds a subsection's
    own text.  notes: (act, section, subsection, note, ord), act `current` or `enacted`, subsection null for the
    section's.  index: citation_index().  Actions: chapter_appended, historical_section, restored_section,
    historical_subsection, restored_subsection, historical_version, historical_clause, restored_clause.  Items
    in both without a supported change give no row.  A section is matched inside its chapter (scope="chapter",
    so one that moved is added again) or anywhere (scope="document").  Of equal current keys the last counts.
    Items meet operations and notes by section, level and identifier.  An item's notes are joined to one text once,
    however many chapters have it; shown: what is to be returned of that text, such as a hash, if not the text itself.
    """
    cur, old = _keyed(current), _keyed(enacted)
    if scope == "document":
        home = cur.groupBy("section").agg(F.max_by("chapter", "ord").alias("_home"))
        old = old.join(home, "section", "left").withColumn("chapter", F.coalesce("_home", "chapter")).drop("_home")
    at = ["chapter", "section", "subsection"]
    flag = lambda d, keys, name: d.select(*keys).distinct().withColumn(name, F.lit(True))
    latest = cur.groupBy(*at, F.coalesce("clause", F.lit("")).alias("_clause")).agg(F.max_by("text", "ord").alias("current_text"))
    item = old.groupBy(*at, "clause").agg(F.max_by("text", "ord").alias("text")).withColumn("_clause", F.coalesce("clause", F.lit("")))
    with_clauses = flag(item.filter("clause IS NOT NULL"), at, "_has_clauses")
    item = item.join(flag(cur, ["chapter"], "in_chapter"), "chapter", "left").join(flag(cur, at[:2], "in_section"), at[:2], "left").join(flag(cur, at, "in_subsection"), at, "left")
    item = item.join(latest, [*at, "_clause"], "left").join(with_clauses, at, "left").withColumn("_there", F.col("current_text").isNotNull())
    item = cut(item, "provisions")  # four kinds of items and all that they join with build on it
    no = lambda c: F.coalesce(F.col(c), F.lit(False)) == F.lit(False)
    null = F.lit(None).cast("string")
    chapters = item.filter(no("in_chapter")).select(F.lit("chapter").alias("level"), "chapter", null.alias("section"), null.alias("subsection"), null.alias("clause"), null.alias("text")).distinct()
    sections = item.filter(~no("in_chapter") & no("in_section")).select(F.lit("section").alias("level"), *at[:2], null.alias("subsection"), null.alias("clause"), null.alias("text"), F.lit(False).alias("_there"), null.alias("current_text")).distinct()
    matched = item.filter("in_section")
    subs = matched.filter(no("in_subsection")).groupBy(*at).agg(F.max(F.when(F.col("clause").isNull(), F.col("text"))).alias("text"))
    subs = subs.select(F.lit("subsection").alias("level"), *at, null.alias("clause"), "text", F.lit(False).alias("_there"), null.alias("current_text"))
    inside = matched.filter("in_subsection")
    clauses = inside.filter("clause IS NOT NULL").select(F.lit("clause").alias("level"), *at, "clause", "text", "_there", "current_text")
    versions = inside.filter(F.col("clause").isNull() & no("_has_clauses")).select(F.lit("subsection").alias("level"), *at, null.alias("clause"), "text", F.lit(True).alias("_there"), "current_text")
    items = sections.unionByName(subs).unionByName(clauses).unionByName(versions).withColumn("_id", F.coalesce("clause", "subsection", "section"))
    keys = ["level", *at, "clause"]

    # citations hang on section, level and identifier, notes on the subsection too, but neither on the chapter
    level, ident = F.col("level"), F.col("_id")
    below = F.coalesce("subsection", F.lit("\x1e"))
    asked = items.select("level", "section", "subsection", "_id", below.alias("_below")).distinct()
    by_item = ["level", "section", "_id"]
    # operations repeat citations, so each is kept once a target, before items meet it
    first = F.min(F.struct("doc_ord", "op_ord")).alias("_first")
    cites = cut(index.groupBy("section", "target", "citation").agg(first, F.bool_or(F.col("operation") == "omitted").alias("_out")), "citations")
    cited = named_targets(asked.select(*by_item).distinct(), cites.select("section", "target").distinct(), "level", "_id")
    cited = cited.join(cites, ["section", "target"]).withColumn("_omits", F.col("_ends") & F.col("_out"))
    cited = distinct_listed(cited, by_item, "citation", ["_first"]).join(cited.groupBy(*by_item).agg(F.bool_or("_omits").alias("_omits")), by_item)
    local = distinct_listed(_local_notes(asked, notes), [*by_item, "_below"], "note", ["_a", "note_ord"])
    said = asked.join(cited, by_item, "left").join(local, [*by_item, "_below"], "left")
    none = F.array().cast("array<string>")
    note = F.when(F.col("note").isNull(), F.array_join(F.coalesce("citation", none), "; ")).otherwise(F.array_join(F.array_distinct(F.concat("note", F.coalesce("citation", none))), "; "))
    said = said.select(*by_item, "_below", "_omits", note.alias("_note")).select(*by_item, "_below", "_omits", (F.col("_note") != "").alias("_said"), shown(F.col("_note")).alias("source_note"))
    said = cut(said, "source-notes")
    noted = items.withColumn("_below", below).join(said, [*by_item, "_below"], "left")
    noted = noted.withColumn("change_type", F.when(F.col("_said"), F.when(F.col("_omits"), "omitted").otherwise("substituted")))
    new = noted.filter("NOT _there").withColumn("action", F.concat(F.when(F.col("_said"), "historical_").otherwise("restored_"), "level"))
    changed = materially_different(noted.filter("_there AND _said"), "text", "current_text")
    changed = changed.withColumn("action", F.when(level == "clause", "historical_clause").otherwise("historical_version"))
    out = [*keys, "action", "change_type", "source_note", "text"]
    appended = chapters.select(*keys, F.lit("chapter_appended").alias("action"), null.alias("change_type"), shown(F.lit("")).alias("source_note"), "text")
    return appended.unionByName(new.select(*out)).unionByName(changed.select(*out))


def back_fill(provision_notes: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, lists): provision_notes (section, note, …) with note_list, and chunks (section, chunk, text) of ordinance notes.

    note_list is the list that stands for the note, null where the note stays: unresolved notes of sections that ordinances
    amend get their section's list.  Notes meet sections, not texts; lists.texts() or lists.digests() of the lists join by note_list.
    """
    made = ordinance_note(*map(F.col, ("title", "operation", "target", "principal_section", "page_reference")))
    named = ops.select("*", F.upper("principal_section").alias("section"))
    amended = named.filter(F.coalesce(made, F.lit("")) != "").select(F.col("section").alias("_s")).distinct()
    open_ = F.when(F.col("note") == UNRESOLVED, F.upper("section"))
    notes = provision_notes.withColumn("_open", open_).join(amended, F.col("_open") == F.col("_s"), "left").withColumn("note_list", F.col("_s")).drop("_open", "_s")
    return notes, L.listed(named.select("section", "title", "operation", "target", "principal_section", "page_reference", "doc_ord", "op_ord"), "section", made, ["doc_ord", "op_ord"])


def section_references(texts: DataFrame) -> DataFrame:
    """Chunks (section, chunk, text) of the documents whose texts name a section of the principal Act, duplicates kept, in order."""
    pattern = r"(?i)(?:(?:in|after|before)\s+)?sections?\s+([0-9]+[A-Z]?)\s+of\s+(?:the\s+principal\s+Act|the\s+Companies\s+Act,?\s*2013)"
    found = texts.select("document", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("n", "section"))
    return L.listed(found.withColumn("section", F.upper("section")), "section", F.col("document").cast("string"), ["document", "n"], distinct=False, sep=",")


def operation_violations(ops: DataFrame) -> DataFrame:
    """ops with what is wrong: a section that is no number, or wording missing though nothing was omitted; null if fine."""
    empty = (F.coalesce("enacted_text", F.lit("")) == "") & (F.coalesce("source_excerpt", F.lit("")) == "")
    kinds = F.col("operation").isin("inserted", "omitted", "substituted", "amended")
    return ops.withColumn(
        "violation",
        F.when(~kinds, "operation").when(~F.col("principal_section").rlike("(?i)^[0-9]+[A-Z]*$"), "section").when((F.col("operation") != "omitted") & empty, "wording"),
    )
