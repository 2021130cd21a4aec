"""What readers ask: search, jumps, links, glossary, diffs, related documents, order and validity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from codicil.functions import text as X
from codicil.operators import lists as L
from codicil.operators import statute as S
from codicil.sources.shared import cut

#: Rows of a part of a section's wording, and those of the next part that go with it.
PART_ROWS, MORE_ROWS = 128, 32


def _wording(fragments: DataFrame) -> DataFrame:
    """(chapter, section, ord, chapter_title, title, row): what is searched of each fragment."""
    row = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("subsection_no", "clause_no", "text", "note")])
    return fragments.filter(S.real_chapter(F.col("chapter_no"))).select(S.key(F.col("chapter_no")).alias("chapter"), F.upper("section_no").alias("section"), "ord", "chapter_title", "title", row.alias("row"))


def _heads(wording: DataFrame) -> DataFrame:
    """(chapter, section, position, _head): a section's first place, and the titles there with its numbers.

    Places are added up before titles are looked at, as a least title would have Spark sort all rows.
    """
    at = wording.groupBy("chapter", "section").agg(F.min("ord").alias("position"))
    first = wording.join(at.select(F.struct("chapter", "section", F.col("position").alias("ord")).alias("_at")), F.struct("chapter", "section", "ord") == F.col("_at"))
    heads = first.groupBy("chapter", "section").agg(F.first("ord").alias("position"), F.min_by("chapter_title", "ord").alias("_ct"), F.min_by("title", "ord").alias("_t"))
    return heads.select("chapter", "section", "position", F.concat_ws(" ", "chapter", "_ct", "section", "_t").alias("_head"))


def search_blobs(fragments: DataFrame) -> DataFrame:
    """(chapter, section, position, blob): all of a section's wording, lower case, in order."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "row")))
    g = _wording(fragments).groupBy("chapter", "section").agg(F.min("ord").alias("position"), F.min_by("chapter_title", "ord").alias("_ct"), F.min_by("title", "ord").alias("_t"), F.transform(parts, lambda p: p["row"]).alias("_rows"))
    return g.select("chapter", "section", "position", F.lower(F.concat_ws(" ", "chapter", "_ct", "section", "_t", F.array_join("_rows", " "))).alias("blob"))


def search_parts(fragments: DataFrame) -> DataFrame:
    """(chapter, section, position, nth, own, part): search_blobs() in parts, so that no row grows with a section.

    The first `own` characters of each part, in the order of nth, make up the blob.  After them a part goes on with the
    first MORE_ROWS rows of the next, each of one character at least, so that what lies across two parts is whole in one.
    """
    f, of = _wording(fragments), F.struct("chapter", "section").alias("_of")
    heads = cut(_heads(f).select(of, "position", "_head"), "heads")  # they go to the sort, which reads its rows twice, and to the parts
    rows = f.select(of, F.lit(1).alias("_kind"), "ord", F.concat(F.lit(" "), "row").alias("_row"))
    rows = heads.select("_of", F.lit(0).alias("_kind"), F.col("position").alias("ord"), F.col("_head").alias("_row")).unionByName(rows)
    home = F.expr(f"rank div {PART_ROWS}")
    also = F.when((F.col("rank") % PART_ROWS < MORE_ROWS) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    dealt = L.ranked(rows, "_of", "_row", ["_kind", "ord"], distinct=False).select("_of", "rank", home.alias("_home"), F.lower("_row").alias("_text"), F.explode(also).alias("nth"))
    own = F.sum(F.when(F.col("_home") == F.col("nth"), F.length("_text")))
    held = F.array_sort(F.collect_list(F.struct("rank", "_text")))
    parts = dealt.groupBy("_of", "nth").agg(own.alias("own"), F.array_join(F.transform(held, lambda x: x["_text"]), "").alias("part"))
    return parts.join(heads.select("_of", "position"), "_of").select("_of.*", "position", "nth", "own", "part")


def search(blobs: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """The first sections in reading order whose text holds the query, literally; none for under two characters."""
    q = query.strip().lower()
    hits = blobs.filter(F.contains("blob", F.lit(q))) if len(q) >= 2 else blobs.limit(0)
    return hits.orderBy("position").limit(limit)


def jump(sections: DataFrame, query: str) -> DataFrame:
    """The first section whose number the query is, with or without `section` before and a dot behind."""
    q = query.strip().upper().removeprefix("SECTION ").strip().removesuffix(".")
    return sections.filter(F.upper("section") == q).orderBy("position").limit(1)


# Links and terms ------------------------------------------------------------------------------------------

# Terms that are too common to explain.
EXCLUDED_TERMS = ["act", "company"]
#: A glossary of up to this many terms is matched as one pattern; a larger one is joined word by word.
PATTERN_TERMS = 2000


def eligible_terms(glossary: DataFrame) -> DataFrame:
    """glossary (term, provision_id) without the terms that the reference passes over (F20): short and common ones."""
    return glossary.filter((F.length("term") >= 3) & ~F.lower("term").isin(EXCLUDED_TERMS))


def single_word_terms(provisions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(provision_id, term, n): how often each one-word term of the glossary is in a provision's text.

    Words of letters and digits are joined to the terms, so glossary and text may both be large; a provision's
    own terms are left out.  The texts are summed up per provision and word before the join.
    """
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    counted = provisions.select("provision_id", F.explode(words).alias("_word")).groupBy("provision_id", "_word").agg(F.count("*").alias("n"))
    terms = eligible_terms(glossary).select(F.lower("term").alias("_word"), F.col("provision_id").alias("_own"), "term").dropDuplicates(["_word"])
    return counted.join(terms, "_word").filter(~F.col("_own").eqNullSafe(F.col("provision_id"))).select("provision_id", "term", "n")


def term_spans(provisions: DataFrame, terms: list[str]) -> DataFrame:
    """(provision_id, nth, found): occurrences of any term in list order, leftmost, not overlapping, bounded by other
    than letters and digits.  For short lists, which become one pattern."""
    if len(terms) > PATTERN_TERMS:
        raise ValueError("too many terms for one pattern; use glossary_spans()")
    pattern = r"(?i)(?<![A-Za-z0-9])(" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?![A-Za-z0-9])"
    return provisions.select("provision_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("nth", "found"))


@F.pandas_udf(ArrayType(IntegerType()))
def _apart(starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Places of the spans, in order of their starts, that overlap with none kept before."""

    def kept(row_starts, row_sizes) -> list[int]:
        end, places = 0, []
        for place, (start, size) in enumerate(zip(row_starts, row_sizes)):
            if start >= end:
                places.append(place)
                end = start + size
        return places

    return pd.Series([kept(a, b) for a, b in zip(starts, sizes)], dtype=object)


def glossary_spans(provisions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(provision_id, nth, found, term, owner): as term_spans(), for a glossary (term, provision_id, ord) of any size.

    A provision's own terms are left out; the least ord goes first among terms at one place.  Runs of words, as long as
    some term is, are joined to the terms, and only matches are gathered by provision.  Terms that do not begin and end
    with a letter or digit of ASCII raise; term_spans() takes them.  Null and empty texts have no row.
    """
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = F.when(F.rlike("term", F.lit(r"\A[A-Za-z0-9](?s:.*[A-Za-z0-9])?\z")), F.col("term")).otherwise(F.raise_error(F.concat(F.lit("not a term of words: "), F.col("term"))))
    terms = eligible_terms(glossary).select(lower(whole).alias("_key"), F.regexp_count(whole, F.lit("[A-Za-z0-9]+")).alias("_size"), "term", F.col("provision_id").alias("owner"), "ord")
    sizes = [r["_size"] for r in terms.select("_size").distinct().collect()]  # as many as terms have lengths in words
    if not sizes:
        return provisions.limit(0).select("provision_id", F.lit(0).alias("nth"), F.lit("").alias("found"), F.lit("").alias("term"), F.lit(None).cast(glossary.schema["provision_id"].dataType).alias("owner"))
    run = lambda n: rf"(?<![A-Za-z0-9])(?=([A-Za-z0-9]++(?:[^A-Za-z0-9]++[A-Za-z0-9]++){{{n - 1}}}))"  # noqa: E731  n words from each word on
    by_size = F.array(*[F.struct(F.lit(n).alias("_size"), F.regexp_extract_all("text", F.lit(run(n)), 1).alias("_runs")) for n in sorted(sizes)])
    runs = provisions.select("provision_id", F.explode(by_size).alias("_of")).select("provision_id", "_of._size", F.posexplode("_of._runs").alias("_at", "found"))
    of_owner = terms.groupBy("_key", "_size", "owner").agg(F.min(F.struct("ord", "term")).alias("_first")).select("_key", "_size", "owner", "_first.*")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("ord", "owner"))
    asked = of_owner.withColumn("_nth", nth).filter("_nth <= 2").drop("_nth")  # a provision leaves out its own, so it takes one of two owners' terms
    hits = runs.withColumn("_key", lower(F.col("found"))).join(asked, ["_key", "_size"]).filter(~F.col("owner").eqNullSafe(F.col("provision_id")))
    hit = F.struct("_at", "ord", "owner", "_size", "found", F.when(F.col("term") != F.col("found"), F.col("term")).alias("term"))  # at one place all but the first overlap it
    kept = hits.groupBy("provision_id").agg(F.array_sort(F.collect_list(hit)).alias("_hits")).withColumn("_kept", _apart("_hits._at", "_hits._size"))
    found = kept.select("provision_id", F.posexplode(F.transform("_kept", lambda i: F.get("_hits", i))).alias("nth", "_hit"))
    return found.select("provision_id", "nth", "_hit.found", F.coalesce("_hit.term", "_hit.found").alias("term"), "_hit.owner")


def cross_references(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """(from_section, to_section, n, resolved): sections that texts (section, text) mention."""
    found = texts.select(F.col("section").alias("from_section"), F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\bsection\s+([0-9]+[A-Za-z]?)(?!\w)"), 1)).alias("to_section"))
    found = found.groupBy("from_section", F.upper("to_section").alias("to_section")).agg(F.count("*").alias("n"))
    known = sections.select(F.upper("section").alias("to_section")).distinct().withColumn("_known", F.lit(True))
    return found.join(known, "to_section", "left").select("from_section", "to_section", "n", F.coalesce("_known", F.lit(False)).alias("resolved"))


def cited_sources(notes: DataFrame, years: list[str]) -> DataFrame:
    """(…, year, page): the amendment Acts of a fixed list of years that a note cites, with the page of the first citation."""
    d = notes.select("*", F.explode(F.array(*map(F.lit, years))).alias("year"))
    title = F.concat(F.lit(r"(?i)companies\s*(?:\(\s*amendment\s*\)|amendment)\s*(?:act,?\s*)?"), F.col("year"))
    after = F.when(F.rlike("note", title), F.regexp_replace("note", F.concat(F.lit(r"(?s)\A.*?"), title), F.lit("")))
    until = F.split(after, r"(?i);\s*(?=(?:inserted|omitted|substituted|amended)\s+by\s+|(?:the\s+)?companies\s*(?:\(\s*amendment\s*\)|amendment))", 2)[0]
    return d.withColumn("_until", until).filter("_until IS NOT NULL").withColumn("page", F.nullif(F.regexp_extract("_until", r"(?i)PDF\s+page\s+([0-9]+)", 1), F.lit(""))).drop("_until")


# Overlays, groups and relations ---------------------------------------------------------------------------


def overlay(provisions: DataFrame, nodes: DataFrame, order: str = "node_ord") -> DataFrame:
    """provisions (section, label, text, status) with curated text and status: verified line, node's text, own text.

    Nodes (section, label, verified_text, current_text, status) match by normalised label, a later node of the
    same label counting; provisions without a node stay as they are.
    """
    n = nodes.groupBy(F.col("section"), X.identifier(F.col("label")).alias("_label")).agg(F.max_by(F.struct("verified_text", "current_text", F.col("status").alias("_status")), order).alias("_n"))
    d = provisions.withColumn("_label", X.identifier(F.col("label"))).join(n, ["section", "_label"], "left")
    return d.withColumn("text", F.coalesce("_n.verified_text", "_n.current_text", "text")).withColumn("status", F.coalesce("_n._status", "status")).drop("_n", "_label")


def current_and_history(current: DataFrame, historical: DataFrame) -> DataFrame:
    """(section, identifier, current, historical, position): entries (section, label, text, ord) by normalised label,
    groups in the order of their first entry, current ones before historical ones."""
    both = current.withColumn("_kind", F.lit(0)).unionByName(historical.withColumn("_kind", F.lit(1)))
    key = F.coalesce(F.nullif(X.identifier(F.col("label")), F.lit("")), F.col("label"), F.concat(F.lit("unknown-"), F.col("_kind").cast("string"), F.lit("-"), F.col("ord").cast("string")))
    texts = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, F.struct("ord", "text")))), lambda x: x["text"]), " | ")
    g = both.groupBy("section", key.alias("identifier")).agg(texts(0).alias("current"), texts(1).alias("historical"), F.min(F.struct("_kind", "ord")).alias("_first"))
    at = Window.partitionBy("section").orderBy("_first")
    return g.withColumn("position", F.row_number().over(at)).drop("_first")


def distinct_relationships(edges: DataFrame) -> DataFrame:
    """The first edge (provision_id, document_id, sort_order) to each document; a null document is one too."""
    w = Window.partitionBy("provision_id", "document_id").orderBy("sort_order", "relationship_id")
    return edges.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def surplus_relationships(edges: DataFrame) -> DataFrame:
    """(provision_id, removed): how many edges distinct_relationships() leaves out."""
    n = edges.groupBy("provision_id").agg(F.count("*").alias("_all"), (F.count_distinct("document_id") + F.max(F.col("document_id").isNull().cast("int"))).alias("_kept"))
    return n.select("provision_id", (F.col("_all") - F.col("_kept")).alias("removed")).filter("removed > 0")


def instrument_categories(kind: Column) -> Column:
    """Rules and Notifications: a document may be in both or neither."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.array_compact(F.array(F.when(F.contains(k, F.lit("rule")), "Rules"), F.when(k.rlike("form|notification|order|circular"), "Notifications")))


def tab_counts(edges: DataFrame, callouts: DataFrame) -> DataFrame:
    """(provision_id, rules, notifications, callouts, amendments, bulbs) of readers' tabs."""
    tabs = instrument_categories(F.col("instrument_type"))
    e = distinct_relationships(edges).groupBy("provision_id").agg(F.count_if(F.array_contains(tabs, "Rules")).alias("rules"), F.count_if(F.array_contains(tabs, "Notifications")).alias("notifications"))
    kind = F.col("callout_type")
    c = callouts.groupBy("provision_id").agg(F.count_if(~kind.isin("amendment", "bulb")).alias("callouts"), F.count_if(kind == "amendment").alias("amendments"), F.count_if(kind == "bulb").alias("bulbs"))
    return e.join(c, "provision_id", "full_outer").fillna(0)


def refreshed_order(shown: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows: those shown before in their old order, then new ones in theirs (`position`).

    shown (group, key, ord), fresh (group, key, ord, …).
    """
    d = fresh.join(shown.select("group", key, F.col("ord").alias("_old")), ["group", key], "left")
    w = Window.partitionBy("group").orderBy(F.col("_old").isNull(), F.coalesce("_old", "ord"))
    return d.withColumn("position", F.row_number().over(w)).drop("_old")


def family_predecessor(documents: DataFrame, strict: bool = False) -> DataFrame:
    """documents (id, title, date, text) with predecessor_id: of its family's other documents with text the last by date.

    The other need not be older unless strict.  Within a family only the two last dated documents can be
    anybody's predecessor, so no family is joined with itself unless strict.
    """
    d = documents.withColumn("family", X.family_key(F.col("title"))).withColumn("_day", F.coalesce("date", F.lit("")))
    has_text = F.coalesce("text", F.lit("")) != ""
    if strict:
        w = Window.partitionBy("family").orderBy("_day", "id").rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn("predecessor_id", F.last(F.when(has_text, F.col("id")), True).over(w)).drop("_day")
    ranked = d.filter(has_text).withColumn("_nth", F.row_number().over(Window.partitionBy("family").orderBy(F.col("_day").desc(), F.col("id").desc()))).filter("_nth <= 2")
    last = ranked.groupBy("family").agg(F.max(F.when(F.col("_nth") == 1, F.col("id"))).alias("_last"), F.max(F.when(F.col("_nth") == 2, F.col("id"))).alias("_second"))
    return d.join(last, "family", "left").withColumn("predecessor_id", F.when(F.col("_last") != F.col("id"), F.col("_last")).otherwise(F.col("_second"))).drop("_last", "_second", "_day")


def valid_on(rows: DataFrame, day: Column) -> DataFrame:
    """Rows whose validity effective_from to effective_to holds the day, both ends inclusive, null ends open."""
    start, end = F.col("effective_from"), F.col("effective_to")
    return rows.filter((start.isNull() | (start <= day)) & (end.isNull() | (end >= day)))


# Days are numbers from the first of year 1; all days up to year 9999 fit in so many binary places.
_DAY_BITS, _DAY_ZERO = 22, 719163


def _day_number(day: Column) -> Column:
    return F.unix_date(day.cast("date")) + _DAY_ZERO


def _spans(rows: DataFrame) -> DataFrame:
    """rows with (_level, _node): the fewest aligned spans of 2 ** level days that make up the validity, none if it ends before it starts."""
    start = F.greatest(F.coalesce(_day_number(F.col("effective_from")), F.lit(0)), F.lit(0))
    end = F.least(F.coalesce(_day_number(F.col("effective_to")), F.lit(2**_DAY_BITS - 1)), F.lit(2**_DAY_BITS - 1)) + 1
    spans = []
    for k in range(_DAY_BITS + 1):
        first, last = F.shiftright(start + (2**k - 1), k), F.shiftright(end, k)
        span = lambda node, k=k: F.struct(F.lit(k).alias("level"), node.alias("node"))
        odd = lambda x: x % 2 == 1
        spans += [F.when((first < last) & odd(first), span(first)), F.when((first < last) & odd(last), span(last - 1))]
    found = F.filter(F.array(*spans), lambda x: x.isNotNull())
    return rows.select("*", F.explode(found).alias("_s")).select(*rows.columns, F.col("_s.level").alias("_level"), F.col("_s.node").alias("_node"))


def _around(days: DataFrame, day: str) -> DataFrame:
    """days with every aligned span (_level, _node) that holds the day; null days have none."""
    spans = F.transform(F.sequence(F.lit(0), F.lit(_DAY_BITS)), lambda k: F.struct(k.alias("level"), F.floor(_day_number(F.col(day)) / F.pow(F.lit(2.0), k)).cast("int").alias("node")))
    return days.filter(F.col(day).isNotNull()).select("*", F.explode(spans).alias("_s")).select(*days.columns, F.col("_s.level").alias("_level"), F.col("_s.node").alias("_node"))


def valid_on_days(rows: DataFrame, days: DataFrame, day: str, on: list[str]) -> DataFrame:
    """(columns of days, columns of rows other than `on`): each row with each of the days on which it is valid, as valid_on() has it.

    on: columns that must be equal besides, in both tables; none is allowed.  A validity is cut into at most two aligned
    spans of each length, and a day lies in one span of each, so an equi-join finds every pair exactly once: no range is
    compared, however many days there are.  Days of the years 1 to 9999; repeated rows and days give repeated pairs.
    """
    keys = ["_level", "_node", *on]
    return _around(days, day).join(_spans(rows), keys).select(*days.columns, *[c for c in rows.columns if c not in on])


def valid_counts(rows: DataFrame, days: DataFrame, day: str, on: list[str]) -> DataFrame:
    """(columns of days, n): how many rows are valid on each day.  Rows are added up by span before the join, so no pair is made."""
    keys = ["_level", "_node", *on]
    spans = _spans(rows).groupBy(*keys).agg(F.count("*").alias("_rows"))
    every = days.select(*on, day).filter(F.col(day).isNotNull()).distinct()
    sums = _around(every, day).join(spans, keys).groupBy(*on, day).agg(F.sum("_rows").alias("_n"))
    return days.join(sums, [*on, day], "left").select(*days.columns, F.coalesce("_n", F.lit(0)).alias("n"))


def live_revisions(revisions: DataFrame, field: str, day: Column) -> DataFrame:
    """Revisions of a field effective on a day that are neither undone nor undo another."""
    return revisions.filter((F.col("field_name") == field) & (F.col("effective_date") == day) & F.col("undone_by_revision_id").isNull() & F.col("reverts_revision_id").isNull())


def revision_text() -> Column:
    """All that a revision shows, as one text to search."""
    return F.concat_ws(" ", "section", "label", F.col("id").cast("string"), "old_value", "new_value")


def change_history(revisions: DataFrame, query: str = "", field: str | None = None, section: str | None = None) -> DataFrame:
    """Revisions by substring of all they show, by field or family of fields (`callout_*`), and by section."""
    d = revisions.filter(F.contains(F.lower(revision_text()), F.lit(query.lower())))
    if field:
        d = d.filter(F.startswith("field_name", F.lit(field[:-1])) if field.endswith("*") else F.col("field_name") == field)
    return d.filter(F.col("section") == section) if section else d


def inbox(feedback: DataFrame, query: str) -> DataFrame:
    return feedback.filter(F.contains(F.lower(F.concat_ws(" ", "sender_name", "message")), F.lit(query.lower())))


def evidence_leaves(rows: DataFrame, column: str) -> DataFrame:
    """(…, label, text) of a one-level JSON object: keys with blanks for underscores; null and empty values dropped."""
    d = rows.select("*", F.explode(F.from_json(column, "map<string,string>")).alias("label", "text_value"))
    return d.filter(F.coalesce("text_value", F.lit("")) != "").withColumn("label", F.replace("label", F.lit("_"), F.lit(" "))).withColumnRenamed("text_value", "value_text")


# Order ----------------------------------------------------------------------------------------------------

# Roman numerals.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(c: Column) -> Column:
    """The value of Roman letters, null for anything else: a smaller one before a larger one counts down."""
    letters = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    numeral = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    values = F.transform(letters, lambda x: numeral[x])
    total = F.aggregate(F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return F.when(c.rlike("(?i)^[ivxlcdm]+$"), total)


def ordered_labels(rows: DataFrame, group: str, label: str) -> DataFrame:
    """rows with position in their group: by number if all labels are numbers, by Roman value if all are Roman, else
    naturally.  The kind is the group's, so that the order is total where comparing pairs is not."""
    w = Window.partitionBy(group)
    key = X.identifier(F.col(label))
    d = rows.withColumn("_k", key).withColumn("_digits", F.min(key.rlike("^[0-9]+$")).over(w)).withColumn("_roman", F.min(key.rlike("^[ivxlcdm]+$")).over(w))
    # digits in the order of their numbers, however many they are: first how many, without leading zeros
    bare = lambda c: F.ltrim(c, F.lit("0"))
    sortable = lambda c: F.concat(F.lpad(F.length(bare(c)).cast("string"), 9, "0"), bare(c))
    number = F.when(~F.col("_digits") & F.col("_roman"), roman_value(F.col("_k"))).otherwise(0)
    parts = F.regexp_extract_all("_k", F.lit("([0-9]+|[^0-9]+)"), 1)
    padded = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), sortable(p)).otherwise(p)), "\x1f")
    natural = F.when(F.col("_roman"), "").otherwise(padded)
    return d.withColumn("position", F.row_number().over(w.orderBy(number, natural, label))).drop("_k", "_digits", "_roman")


def verified_clause_order(clauses: DataFrame, lines: DataFrame) -> DataFrame:
    """clauses (section, subsection, clause, ord) with position by a verified list of labels (section, line, label).

    A clause's line is the first one of its label after its subsection's line and before the next subsection's;
    clauses without one come last, in their old order.
    """
    at = ["section", "subsection"]
    labelled = lines.withColumn("_l", X.identifier(F.col("label")))
    subs = clauses.select(*at).distinct().withColumn("_l", X.identifier(F.col("subsection")))
    start = labelled.join(subs, ["section", "_l"]).groupBy(*at).agg(F.min("line").alias("_from"))
    start = start.withColumn("_to", F.lead("_from").over(Window.partitionBy("section").orderBy("_from")))
    c = clauses.withColumn("_l", X.identifier(F.col("clause"))).join(start, at, "left")
    line = labelled.select("section", "_l", "line")
    hit = c.join(line, ["section", "_l"]).filter((F.col("line") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line") < F.col("_to")))).groupBy(*at, "clause").agg(F.min("line").alias("_line"))
    d = c.join(hit, [*at, "clause"], "left")
    w = Window.partitionBy(*at).orderBy(F.coalesce("_line", F.lit(2**31 - 1)), "ord")
    return d.withColumn("position", F.row_number().over(w)).drop("_l", "_from", "_to", "_line")


def library_order(documents: DataFrame) -> DataFrame:
    """documents with position: the latest updated_at first, then the highest id, both as text, null being empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return documents.orderBy(text("updated_at").desc(), text("id").desc())


def snapped_anchor(text: Column, offset: Column) -> Column:
    """struct(offset, kind, quote): the boundary nearest to an offset — ends, ends of sentences and words, the first
    of equally near ones — with thirty characters on each side."""
    n = F.length(text)
    boundary = r"(?:(?<=[A-Za-z0-9_])(?=[^A-Za-z0-9_])|(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[.!?;:])(?=\s))"
    # the last boundary up to the offset and the first one behind it, however far away
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), offset + 1), "(?s)^(.+)" + boundary, 1))
    after = F.length(F.regexp_extract(F.substring(text, offset + 1, n), "(?s)^(.+?)" + boundary, 1))
    at = lambda place, i: F.struct(F.abs(i - offset).alias("d"), F.lit(place).alias("place"), i.alias("i"))
    every = F.array(at(0, F.lit(0)), at(1, n), F.when(before > 0, at(2, before)), F.when(after > 0, at(3, offset + after)))
    nearest = F.array_min(F.filter(every, lambda x: x.isNotNull()))["i"]
    return F.transform(F.array(nearest), lambda best: _anchor(text, n, best))[0]


def _anchor(text: Column, n: Column, best: Column) -> Column:
    kind = F.when(best == n, "end").when(F.substring(text, F.lit(1), best).rlike(r"[.!?;:]\s*$"), "sentence").otherwise("word")
    start = F.greatest(F.lit(0), best - 30)
    return F.struct(best.alias("offset"), kind.alias("kind"), F.substring(text, start + 1, F.least(n, best + 30) - start).alias("quote"))


# Differences ----------------------------------------------------------------------------------------------

def _codes(old: list[str], new: list[str]):
    """Both lists as numbers, equal ones for equal tokens."""
    import numpy as np

    codes: dict[str, int] = {}
    return [np.array([codes.setdefault(t, len(codes)) for t in x], np.int32) for x in (old, new)]


def _run_back(a: bytes, b: bytes, i: int, j: int) -> int:
    """How many tokens before i and j are equal, found by ever longer pieces and then ever shorter ones."""
    most, found, step = min(i, j), 0, 1
    while step:
        if found + step <= most and a[4 * (i - found - step) : 4 * (i - found)] == b[4 * (j - found - step) : 4 * (j - found)]:
            found, step = found + step, 2 * step
        else:
            step //= 2
    return found


def _run_on(a: bytes, b: bytes, i: int, j: int) -> int:
    """How many tokens from i and j on are equal, found likewise."""
    most, found, step = min(len(a) // 4 - i, len(b) // 4 - j), 0, 1
    while step:
        if found + step <= most and a[4 * (i + found) : 4 * (i + found + step)] == b[4 * (j + found) : 4 * (j + found + step)]:
            found, step = found + step, 2 * step
        else:
            step //= 2
    return found


def _reaches(a: bytes, b: bytes, n: int, m: int, most: int) -> list[list[int]] | None:
    """At [d][(k + d) // 2] the least i on the diagonal i - j = n - m + k from which d edits suffice up to both ends; None if over
    `most` are needed from the beginning.  Those of d edits come from those of d - 1 and the equal tokens before them."""
    far, levels, base = n + m + 1, [], n - m
    for d in range(most + 1):
        level, below = [], levels[-1] if levels else []
        for x, k in enumerate(range(-d, d + 1, 2)):
            if d == 0:
                i = n
            else:  # an old token more (from k + 1), or a new one more (from k - 1)
                i = far
                if x < d and below[x] - 1 >= 0:
                    i = below[x] - 1
                if x > 0 and below[x - 1] <= n and below[x - 1] < i and below[x - 1] - base - k >= 0:
                    i = below[x - 1]
            j = i - base - k
            if i <= n and 0 <= j <= m:
                i -= _run_back(a, b, i, j)
                if i == 0 and i - base - k == 0:
                    levels.append([*level, i])
                    return levels
            else:
                i = far
            level.append(i)
        levels.append(level)
    return None


def _within(a: bytes, b: bytes) -> bool:
    """Whether the tokens of a are in b, in order."""
    i = j = 0
    n, m = len(a) // 4, len(b) // 4
    while i < n and n - i <= m - j:
        same = _run_on(a, b, i, j)
        i, j = i + same, j + max(1, same)
    return i == n


def word_diff_operations(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(type, value) runs by a longest common subsequence; at equal lengths removing comes before adding.

    Where one list is within the other, only adding or only removing is left.  Else, from the ends backwards, the places from which d edits suffice are found for d = 0, 1, 2, …, so near copies take a
    time that grows with their difference.  The way forwards matches what is equal, and removes where that leaves an
    edit less to do, else adds.  Where the difference is not small against the lengths, the table of lengths is cheaper.
    """
    a, b = _codes(old, new)
    n, m = len(old), len(new)
    first, second = a.tobytes(), b.tobytes()
    one_way = _within(first, second) if n <= m else _within(second, first)
    levels = [] if one_way else _reaches(first, second, n, m, 64 + int(0.1 * (n * m) ** 0.5))
    if levels is None:
        return _by_table(old, new, a, b)
    runs: list[list] = []
    i = j = 0
    d, base = len(levels) - 1, n - m
    while i < n or j < m:
        if same := _run_on(first, second, i, j):
            kind, found, i, j = "same", old[i : i + same], i + same, j + same
        else:
            d -= 1
            x = i + 1 - j - base + d
            if n > m if one_way else j == m or (i < n and x % 2 == 0 and 0 <= x // 2 < len(levels[d]) and levels[d][x // 2] <= i + 1):
                kind, found, i = "removed", old[i : i + 1], i + 1
            else:
                kind, found, j = "added", new[j : j + 1], j + 1
        if runs and runs[-1][0] == kind:
            runs[-1][1].extend(found)
        else:
            runs.append([kind, found])
    return [(kind, "".join(tokens)) for kind, tokens in runs]


def _by_table(old: list[str], new: list[str], a, b) -> list[tuple[str, str]]:
    """The same by the table of lengths.

    One row in so many is kept, and those between are worked out again when the way through it comes there: memory
    grows with the width times the root of the height, and no pair is too long.
    """
    import numpy as np

    rows, wide = len(old), len(new)

    def above(i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1: best of skipping old[i] and of matching it, carried along by a running maximum."""
        row = np.zeros(wide + 1, np.int32)
        best = np.maximum(below[:-1], np.where(b == a[i], below[1:] + 1, 0))
        row[:-1] = np.maximum.accumulate(best[::-1])[::-1]
        return row

    step = max(1, int(rows**0.5))
    kept, row = {rows: np.zeros(wide + 1, np.int32)}, np.zeros(wide + 1, np.int32)
    for i in range(rows - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    block: dict[int, np.ndarray] = {}

    def length(i: int, j: int) -> int:
        if i in kept:
            return int(kept[i][j])
        if i not in block:
            top = min((i // step + 1) * step, rows)
            block.clear()
            r = kept[top]
            for k in range(top - 1, i - i % step, -1):
                r = block[k] = above(k, r)
        return int(block[i][j])

    runs: list[list[str]] = []

    def put(kind: str, value: str) -> None:
        if runs and runs[-1][0] == kind:
            runs[-1][1] += value
        else:
            runs.append([kind, value])

    i = j = 0
    while i < rows or j < wide:
        if i < rows and j < wide and old[i] == new[j]:
            put("same", old[i])
            i, j = i + 1, j + 1
        elif j == wide or (i < rows and length(i + 1, j) >= length(i, j + 1)):
            put("removed", old[i])
            i += 1
        else:
            put("added", new[j])
            j += 1
    return [(k, v) for k, v in runs]


def word_diff(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with diff: array<struct<type,value>>.

    Tokens are white space, runs of letters and digits, and single other characters.  Equal texts are decided
    without Python.
    """
    same = F.col(old).eqNullSafe(F.col(new))
    kind = "array<struct<type:string,value:string>>"

    @F.pandas_udf(kind)
    def runs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"type": k, "value": v} for k, v in word_diff_operations(list(x), list(y))] for x, y in zip(a, b, strict=True)])

    equal = pairs.filter(same).withColumn("diff", F.when(F.coalesce(old, F.lit("")) != "", F.array(F.struct(F.lit("same").alias("type"), F.col(old).alias("value")))).otherwise(F.array().cast(kind)))
    d = pairs.filter(~same).withColumn("_a", tokens(F.col(old))).withColumn("_b", tokens(F.col(new)))
    return equal.unionByName(d.withColumn("diff", runs("_a", "_b")).drop("_a", "_b"))


@F.udtf(returnType="op_ord int, type string, value string")
class WordDiff:
    """The runs of word_diff() as rows, for two lists of tokens(): a table function for joins with LATERAL."""

    def eval(self, old: list, new: list):
        for k, (kind, value) in enumerate(word_diff_operations(old or [], new or [])):
            yield k, kind, value


def tokens(text: Column) -> Column:
    """White space, runs of letters and digits, and other characters one by one; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\s+|[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 1)


def word_diff_rows(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with a row for each run of their difference: op_ord, type, value; none for two empty texts."""
    d = pairs.withColumn("_a", tokens(F.col(old))).withColumn("_b", tokens(F.col(new)))
    return d.lateralJoin(WordDiff(F.col("_a").outer(), F.col("_b").outer())).drop("_a", "_b")
