"""Which clauses, subsections and sections a text names: an inverted index, for joins on what is named.

A text's mentions are found once, by patterns that are the same for all items; items then meet them by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How targets and notes label a clause, a subsection and a whole section.
LABELS = {"clause": r"(?:sub-?clause|clause)", "subsection": r"(?:sub-?section|subsection)"}
WHOLE_SECTION = r"(?is)^(?:(?:in|after|before)\s+)?section\s+(.*?)\s*$"
#: Identifiers may hold so many closing brackets between their first and last, as (1)(a)(ii) does.
INNER_BRACKETS = 2


def bare_identifier(c: Column) -> Column:
    return F.btrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("()"))


def _parts(bare: Column) -> list[Column]:
    """The key by which an identifier meets its mentions, and the white space before and after it."""
    core = F.lower(F.regexp_replace(bare, r"^\s+|\s+$", ""))
    return [core.alias("_key"), F.regexp_extract(bare, r"^(\s*)", 1).alias("_before"), F.regexp_extract(bare, r"(\s*)$", 1).alias("_after")]


def is_at_large(level: Column, identifier: Column) -> Column:
    """Sections, and subsections without a number: what names them names the section as a whole."""
    return (level == "section") | ((level == "subsection") & (F.upper(identifier) == "N/A"))


def with_mentions(texts: DataFrame, text: Column) -> DataFrame:
    """A row for each mention of a clause or subsection in a text: level, _key, _before, _after, _nth and _ends (nothing but
    separators follows it).  A mention is the label and an identifier in brackets."""
    found = []
    for level, label in LABELS.items():
        for inner in range(INNER_BRACKETS + 1):
            pattern = rf"(?is)\b{label}\s*\((?=([^)]*{r'\)[^)]*' * inner})\)[ ,;:-]*+(.?))"
            both = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(name) for k, name in ((1, "raw"), (2, "then"))])
            found.append(F.transform(both, lambda x, i: F.struct(F.lit(level).alias("level"), x["raw"].alias("raw"), i.alias("_nth"), (x["then"] == "").alias("_ends"))))  # noqa: B023
    each = texts.select("*", F.explode(F.concat(*found)).alias("_m"))
    return each.select(*texts.columns, "_m.level", *_parts(F.col("_m.raw")), "_m._nth", "_m._ends")


def with_identifiers(items: DataFrame, level: str, identifier: str) -> DataFrame:
    """items with level and _key as with_mentions() has them, and what white space their mentions need."""
    key, before, after = _parts(bare_identifier(F.col(identifier)))
    kind = F.when(F.col(level) == "clause", "clause").otherwise("subsection")
    return items.select("*", kind.alias("_kind"), key.alias("_own"), before.alias("_first"), after.alias("_last"))


def is_mention() -> Column:
    """The condition by which with_identifiers() meets with_mentions(), besides what else is to be equal."""
    return (F.col("_kind") == F.col("_m.level")) & (F.col("_own") == F.col("_m._key")) & F.endswith("_m._before", "_first") & F.startswith("_m._after", "_last")


def named_targets(items: DataFrame, targets: DataFrame, level: str, identifier: str) -> DataFrame:
    """items (section, …) with each target (section, target) that names them, and _ends: the first mention is the target's end.

    Sections, and subsections without a number, must be the whole target.  A clause's subsection is not looked at, so
    a clause (b) of any subsection matches.
    """
    t = targets.select("section", "target", F.trim("target").alias("_text"))
    items = items.withColumn("_item", F.struct(*items.columns))
    own = with_identifiers(items.filter(~is_at_large(F.col(level), F.col(identifier))), level, identifier)
    m = with_mentions(t, F.col("_text")).select(F.struct("level", "_key", "_before", "_after", "section", "target", "_nth", "_ends").alias("_m"))
    named = own.join(m, is_mention() & (F.col("section") == F.col("_m.section")))
    named = named.groupBy("_item", F.col("_m.target").alias("target")).agg(F.min_by("_m._ends", "_m._nth").alias("_ends"))
    whole = t.select("section", "target", F.regexp_extract("_text", WHOLE_SECTION, 1).alias("_of")).filter("_of <> ''")
    wide = items.filter(is_at_large(F.col(level), F.col(identifier))).join(whole.withColumnRenamed("section", "_s"), (F.col("section") == F.col("_s")) & (F.lower("section") == F.lower("_of")))
    bare = bare_identifier(F.col(identifier))
    ends = (F.col(level) == "section") & (F.lower(bare) == F.lower("_of")) & bare.rlike(r"\w$")
    wide = wide.select("_item", "target", ends.alias("_ends"))
    return named.unionByName(wide).select("_item.*", "target", "_ends")
