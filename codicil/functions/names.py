"""Dates, file names, addresses and small parsers as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codicil.functions.text import squeeze

# Markers of errors that pass, and of rate limits.
TRANSIENT = ["429", "500", "502", "503", "504", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "DEADLINE_EXCEEDED", "INTERNAL", "HIGH DEMAND"]
RATE_LIMIT = ["429", "RESOURCE_EXHAUSTED", "RATE LIMIT", "QUOTA"]

# Kinds of content and their extensions, in the order of the tests.
EXTENSIONS = [("pdf", ".pdf"), ("msword", ".doc"), ("wordprocessingml", ".docx"), ("spreadsheetml", ".xlsx"), ("ms-excel", ".xls"), ("zip", ".zip")]

NAME_BYTES, GAZETTE_BYTES, STEM_BYTES, DIGEST_DIGITS = 245, 240, 238, 12


def component(c: Column, trim: str = " .") -> Column:
    """A part of a file name: forbidden characters as single dashes, NA if nothing is left."""
    c = F.regexp_replace(squeeze(c), r"[<>:\"/\\|?*\x00-\x1f]", "-")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "-{2,}", "-"), F.lit(trim)), F.lit("")), F.lit("NA"))


def cut_bytes(c: Column, most: Column, mark: str = "", trim: str = " ") -> Column:
    """The longest beginning of at most so many UTF-8 bytes, cut between characters, then the mark if it was cut."""
    def shortened(x: Column) -> Column:
        lengths = F.sequence(F.least(F.length(x["c"]), x["most"]), F.lit(0), F.lit(-1))
        n = F.get(F.filter(lengths, lambda k: F.octet_length(F.left(x["c"], k)) <= x["most"]), F.lit(0))
        return F.when(F.octet_length(x["c"]) <= x["most"], x["c"]).otherwise(F.concat(F.rtrim(F.left(x["c"], n), F.lit(trim)), F.lit(mark)))

    return F.transform(F.array(F.struct(c.alias("c"), most.cast("int").alias("most"))), shortened)[0]


def iso_date(c: Column) -> Column:
    """d/m/yyyy or d-m-yyyy as yyyy-mm-dd, without looking at the calendar; anything else as a name's part."""
    c = squeeze(c)
    part = lambda i: F.regexp_extract(c, r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{4})$", i)
    return F.when(part(4) != "", F.concat_ws("-", part(4), F.lpad(part(3), 2, "0"), F.lpad(part(1), 2, "0"))).otherwise(component(c))


def checked_date(c: Column) -> Column:
    """dd/mm/yyyy as a date if there is such a day, else null."""
    return F.when(c.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_date(c, "dd/MM/yyyy"))


def shown_date(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def masked_date(c: Column) -> Column:
    """Typed digits as dd/mm/yyyy."""
    d = F.left(F.regexp_replace(c, "[^0-9]", ""), F.lit(8))
    return F.concat_ws("/", *[F.when(F.length(d) > a, F.substring(d, a + 1, n)) for a, n in ((0, 2), (2, 2), (4, 4))])


def without_size(c: Column) -> Column:
    return F.trim(F.regexp_replace(squeeze(c), r"(?i)\s*\|\s*[0-9]+(?:\.[0-9]+)?\s*(?:KB|MB|GB)\s*$", ""))


def dated_name(date: Column, subject: Column, most: int = NAME_BYTES) -> Column:
    """`date - subject.pdf`; a long subject is cut to the bytes that are left, but to 30 at least."""
    d, s = component(iso_date(date)), component(without_size(subject))
    left = F.greatest(F.lit(30), F.lit(most) - F.octet_length(d) - 3 - 4)
    return F.concat(d, F.lit(" - "), cut_bytes(s, left), F.lit(".pdf"))


def typed_name(date: Column, kind: Column, subject: Column, most: int = NAME_BYTES) -> Column:
    """`date - kind - subject.pdf`, of which only the subject gives way."""
    head = F.concat_ws(" - ", component(iso_date(date)), component(kind))
    return F.concat(head, F.lit(" - "), cut_bytes(component(without_size(subject)), F.greatest(F.lit(30), F.lit(most) - F.octet_length(head) - 7)), F.lit(".pdf"))


def _bytes(s: str) -> int:
    return len(s.encode())


def _cut(s: str, most: int, mark: str = "") -> str:
    raw = s.encode()
    return s if len(raw) <= most else raw[: max(0, most)].decode(errors="ignore").rstrip() + mark


@F.pandas_udf(StringType())
def _rule_names(parts: pd.DataFrame) -> pd.Series:
    def fit(row) -> str:
        p = list(row)
        for i in (1, 4, 2):
            while _bytes(" - ".join(p)) + 5 > NAME_BYTES and _bytes(p[i]) > 30:
                p[i] = _cut(p[i], _bytes(p[i]) - 10)
        return " - ".join(p) + " .pdf"

    return pd.Series([fit(r) for r in parts.itertuples(index=False)], dtype=object)


@F.pandas_udf(StringType())
def _gazette_names(parts: pd.DataFrame) -> pd.Series:
    def fit(row) -> str:
        *p, stem = row
        suffix = f" ({stem}).pdf"
        while _bytes(" - ".join(p) + suffix) > GAZETTE_BYTES and (long := [i for i in GAZETTE_SHRINK if _bytes(p[i]) > 12]):
            i = max(long, key=lambda k: _bytes(p[k]))
            p[i] = _cut(p[i], max(12, _bytes(p[i]) - 8), "…")
        body = " - ".join(p)
        return (body if _bytes(body + suffix) <= GAZETTE_BYTES else _cut(body, GAZETTE_BYTES - _bytes(suffix), "…")) + suffix

    return pd.Series([fit(r) for r in parts.itertuples(index=False)], dtype=object)


#: Places, in the ten fields of a gazette row, of those that give way: subject, office, department, ministry, category, part.
GAZETTE_SHRINK = (4, 3, 2, 1, 5, 6)


def rule_name(rules: Column, contains: Column, date: Column, title: Column) -> Column:
    """`iso date - rules - contains - date - title .pdf`; only names over the budget go through Python.

    The rules' title gives way first, then the single rule's, then what the rules contain, ten bytes at a time
    down to thirty.
    """
    parts = [component(iso_date(date)), component(rules), component(contains), component(F.regexp_replace(squeeze(date), "/", "-")), component(title)]
    plain = F.concat(F.concat_ws(" - ", *parts), F.lit(" .pdf"))
    long = F.octet_length(plain) > NAME_BYTES
    return F.when(long, _rule_names(F.struct(*[F.when(long, p).otherwise("").alias(f"p{i}") for i, p in enumerate(parts)]))).otherwise(plain)


def gazette_name(fields: list[Column], original: Column) -> Column:
    """`field - … (stem).pdf`, the longest descriptive field giving way first."""
    parts = [component(f, " .-_") for f in fields]
    stem = component(F.regexp_replace(original, r"\.[^./]*$", ""), " .-_")
    plain = F.concat(F.concat_ws(" - ", *parts), F.lit(" ("), stem, F.lit(").pdf"))
    long = F.octet_length(plain) > GAZETTE_BYTES
    return F.when(long, _gazette_names(F.struct(*[F.when(long, p).otherwise("").alias(f"p{i}") for i, p in enumerate([*parts, stem])]))).otherwise(plain)


def safe_stem(stem: Column, name: Column, most: int = STEM_BYTES) -> Column:
    """The stem, or if it is long its beginning and some digits of the name's SHA-1, so that names differ."""
    mark = F.concat(F.lit("__"), F.left(F.sha1(F.encode(name, "UTF-8")), F.lit(DIGEST_DIGITS)))
    return F.when(F.octet_length(stem) <= most, stem).otherwise(F.concat(cut_bytes(stem, F.lit(most - 2 - DIGEST_DIGITS), trim=" ."), mark))


def document_url(document_id: Column, category: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.lit("?id="), F.base64(F.encode(document_id, "UTF-8")), F.lit("&category="), category)


def attachment_name(disposition: Column) -> Column:
    """The file name of a content-disposition header: encoded, quoted or bare."""
    d = squeeze(disposition)
    bare = lambda c: F.btrim(F.trim(c), F.lit("\"'"))
    found = lambda p: F.nullif(F.regexp_extract(d, p, 1), F.lit(""))
    coded = found(r"(?i)filename\*\s*=\s*(?:UTF-8'')?([^;]+)")
    coded = F.coalesce(F.try_url_decode(F.replace(bare(coded), F.lit("+"), F.lit("%2B"))), bare(coded))
    names = [coded, found(r'(?i)filename\s*=\s*"([^"]+)"'), bare(found(r"(?i)filename\s*=\s*([^;]+)"))]
    return F.coalesce(*[F.when(n.isNotNull(), squeeze(n)) for n in names], F.lit(""))


def extension(content_type: Column) -> Column:
    value, out = F.lower(squeeze(content_type)), None
    for part, ext in EXTENSIONS:
        test = F.contains(value, F.lit(part))
        out = F.when(test, ext) if out is None else out.when(test, ext)
    return out.otherwise(".pdf")


def shown_range(c: Column) -> Column:
    """struct(first, last, total) of `Showing a-b of N`; null where a number is missing."""
    n = lambda i: F.try_to_number(F.nullif(F.regexp_extract(c, r"(?i)showing\s+([0-9]+)\s*(?:-|to)\s*([0-9]+)\s+of\s+([0-9]+)", i), F.lit("")), F.lit("9999999999")).cast("long")
    return F.struct(n(1).alias("first"), n(2).alias("last"), n(3).alias("total"))


def has_marker(message: Column, markers: list[str] = TRANSIENT) -> Column:
    """A literal test, so a message of 1500 rows holds the marker 500."""
    up = F.upper(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(up, m))


def section_of(provision_id: Column) -> Column:
    return F.nullif(F.regexp_extract(provision_id, ":section:([^:]+)", 1), F.lit(""))


def document_kind(name: Column) -> Column:
    """The kind of an act by its file name; the order of the tests matters."""
    has = lambda *w: F.lower(name).rlike("|".join(w))
    return F.when(has("current", "principal"), "current_act").when(has("bare", "original"), "bare_act").when(has("amendment", "ordinance"), "amendment").otherwise("current_act")


def body_start(content: Column) -> Column:
    """The body from its signature %PDF- on, null without one."""
    at = F.position(F.lit("%PDF-"), F.decode(content, "ISO-8859-1"))
    return F.when(at > 0, F.substring(content, at, F.length(content)))
