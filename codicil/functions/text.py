"""Text clean-up, statistics and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of viewer placeholders, least counts of a good page.
PLACEHOLDER_PHRASES = [
    "please wait...",
    "please wait",
    "if this message is not eventually replaced",
    "your pdf viewer may not be able to display this type of document",
    "to view the full contents of this document",
    "you need a later version of the pdf viewer",
]
LEAST_LATIN, LEAST_WORDS = 120, 20

# Furniture lines of gazettes, and fragments of headings in a legacy font.
FURNITURE_LINES = [
    r"\bREGD\.?\s*NO\.?\s*D\.?\s*L\.?[-–—\s]*33004/99\b",
    r"^EXTRAORDINARY$",
    r"^Section\s+3\s*[-–—]\s*Sub-section\s*\([ivx]+\)$",
    r"^PUBLISHED BY AUTHORITY$",
    r"^No\.\s*\d+\]\s*NEW DELHI,.*/.*\d{4}$",
    r"^\d+\s+GI/\d{4}\s*\(\d+\)$",
]
LEGACY_WORDS = ["Hkkjr", "Hkkx", "jkti=k", "vlk/kj.k", "fnYyh", "lkseokj", "flrEcj", "Hkkæ", "vçSy", "vxLr", "cqèk", "izkf/kdj", "vuqHkkx"]
LEGACY_LINES = ["jftLVah", "izkf/dkj", "izdkf['’]?kr", "ubZ", "c`gLifrokj", "fnlEcj", "ikS[\"'k]", "la[ö-]"]

NBSP = " "
LINE_BREAKS = "[\x0b\x0c\x1c\x1d\x1e\x85  ]"
FAMILY_WORDS = r"\b(amendment|notification|order|rules?|regulations?|[0-9]{4})\b"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space, no-break space included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def _plain_lines(c: Column) -> Column:
    c = F.regexp_replace(_text(c), "\r\n?", "\n")
    c = F.regexp_replace(c, LINE_BREAKS, "\n")
    return F.regexp_replace(F.translate(c, NBSP, " "), "[ \t]+", " ")


def clean_layout(c: Column) -> Column:
    """Layout-preserving clean-up: one kind of line break, single blanks in lines, one blank line at most."""
    c = F.regexp_replace(_plain_lines(c), " ?\n ?", "\n")
    return F.btrim(F.regexp_replace(c, "\n{3,}", "\n\n"), F.lit(" \n"))


def without_devanagari(c: Column) -> Column:
    return F.regexp_replace(c, "[ऀ-ॿ꣠-ꣿ]+", "")


#: Lines of numbering alone: 12A. or (iv) or dashes.
NUMBERING = r"^(?:[(\[{]?[0-9]+[A-Za-z]?[)\]}]?[.:-]?|[(\[][ivxlcdmIVXLCDM]+[)\]]|[-–—]+)$"


def english_lines(c: Column) -> Column:
    """Lines with a Latin letter, and lines of numbering alone; Devanagari is removed before."""
    lines = F.transform(F.split(without_devanagari(_plain_lines(c)), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x.rlike("[A-Za-z]") | x.rlike(NUMBERING)), "\n")


def latin_characters(c: Column) -> Column:
    return F.length(F.regexp_replace(_text(c), "[^A-Za-z]+", ""))


def english_words(c: Column) -> Column:
    return F.regexp_count(_text(c), F.lit(r"\b[A-Za-z][A-Za-z0-9'’.\-]*\b"))


def is_placeholder(c: Column) -> Column:
    """At least two of the phrases; the first of them holds the second, so it counts for both."""
    cleaned = F.array(F.lower(clean_layout(c)))  # in an array, so that it is worked out once for all phrases
    return F.transform(cleaned, lambda text: sum(F.contains(text, F.lit(p)).cast("int") for p in PLACEHOLDER_PHRASES) >= 2)[0]


def page_verdict(c: Column, least_latin: int = LEAST_LATIN, least_words: int = LEAST_WORDS, latin: Column | None = None, words: Column | None = None) -> Column:
    """Why a page's own text will not do, or `good`; latin and words are the text's counts where they are known."""
    return (
        F.when(F.trim(F.regexp_replace(_text(c), r"\s+", " ")) == "", "empty")
        .when(is_placeholder(c), "xfa_placeholder")
        .when((latin_characters(c) if latin is None else latin) < least_latin, "too_few_english_characters")
        .when((english_words(c) if words is None else words) < least_words, "too_few_english_words")
        .otherwise("good")
    )


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _replaced(c: Column, sign: str, pattern: str, to: str) -> Column:
    """regexp_replace() of a pattern whose every match holds `sign`: texts without it are not searched."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, to)).otherwise(t))


def sanitize(c: Column) -> Column:
    """One line: footnote marks, lines of digits and counters dropped, words joined over a line's hyphen."""
    c = _replaced(_replaced(_text(c), "*", r"(?=[0-9])\b[0-9]+\*+", ""), "[", r"[0-9]+\[", "[")
    kept = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"(?i)\A\s*[0-9]+(?:\s+SECTIONS)?\s*\z"))
    # a match begins at the last letter before the hyphen, so that words without one are passed once
    joined = _replaced(F.array_join(kept, " "), "-", r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_]++)", "$1$2")
    return F.trim(F.regexp_replace(joined, r"[^\S ]\s*| \s+", " "))


def without_markup(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"\[\[/?[^\]]+\]\]", "")


def comparison_key(c: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def family_key(c: Column) -> Column:
    """What documents of one family share: the title without kinds, years and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), FAMILY_WORDS, ""), "[^a-z0-9]+", "")


def identifier(c: Column) -> Column:
    return F.regexp_replace(F.lower(_text(c)), r"[()\[\].\s]", "")


def number_prefix(number: Column) -> Column:
    """The pattern of a section's own number before its heading."""
    return F.concat(F.lit(r"(?i)^(?:section\s+)?\Q"), number, F.lit(r"\E[.：:–—-]?\s*"))


def strip_number(title: Column, number: Column) -> Column:
    return F.regexp_replace(_text(title), number_prefix(number), F.lit(""))


def heading_key(text: Column, number: Column) -> Column:
    return comparison_key(strip_number(F.trim(_text(text)), number))


def repair_section_number(c: Column) -> Column:
    """378-I and 378 I become 378I."""
    return F.regexp_replace(F.trim(_text(c)), r"(?<=[A-Za-z0-9])(?:\s*-\s*|\s+)(?=[A-Za-z])", "")


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over code points, as hexadecimal digits."""
    points = F.transform(F.filter(F.split(_text(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    mask = F.lit(0xFFFFFFFF)
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(mask)
    return F.lower(F.hex(F.aggregate(points, F.lit(2166136261).cast("long"), step)))


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(c, F.lit("Document")), F.lit("_"), F.lit(" ")))


def boilerplate_free(c: Column) -> Column:
    """Corpus text without legacy-font headings, Indic script, furniture lines and doubled blank lines.

    Compatibility normalisation (NFKC) is for the caller, see corpus.normalized.
    """
    legacy = r"(?i)\b(?:" + "|".join(rf"\Q{w}\E" for w in LEGACY_WORDS) + r")\b"
    c = F.regexp_replace(_text(c), r"(?is)(?:¹|Â¹)?Hkkx\s+II.{0,180}?(?=\b(?:THE GAZETTE|MINISTRY|NOTIFICATION|FORM|Declaration|section)\b)", " ")
    c = F.regexp_replace(c, r"(?im)(?:^|\n)[^\n]{0,180}(?:fnYyh|lkseokj|flrEcj|Hkkæ|vçSy|vxLr|cqèk)[^\n]{0,180}?(?=NEW DELHI)", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "[ऀ-ൿ]+", " "), legacy, " ")
    for pattern, to in (("[ \t]{2,}", " "), (r"\s+([,.;:])", "$1"), ("\n[ \t]+", "\n"), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    lines = F.transform(F.split(c, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    furniture = "(?i)(?:" + "|".join(FURNITURE_LINES) + ")"
    lines = F.filter(lines, lambda x: ~(x.rlike(furniture) | x.rlike("(?i)(?:" + "|".join(LEGACY_LINES) + ")")))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit(" \n\t\r"))
