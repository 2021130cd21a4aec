"""Pieces of SQL that several oracles share."""

from __future__ import annotations

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

PAGES_SQL = """
pages AS (SELECT doc_id, source, lang, i + 1 AS page, array_to_string(lines[i * 4 + 1 : i * 4 + 4], chr(10)) AS text FROM (
  SELECT doc_id, source, lang, lines, unnest(range(0, (len(lines) - 1) // 4 + 1)) AS i FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"""

ROUTED_SQL = (
    PAGES_SQL
    + r""",
english AS (SELECT *, array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)),
  lambda x: regexp_matches(x, '[A-Za-z]') OR regexp_matches(x, '^([(\[{]?[0-9]+[A-Za-z]?[)\]}]?[.:-]?|[(\[][ivxlcdmIVXLCDM]+[)\]]|[-–—]+)$')), chr(10)) AS english FROM pages),
counted AS (SELECT *, len(regexp_extract_all(english, '[A-Za-z]')) AS latin, len(regexp_extract_all(regexp_replace(english, '[\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]', '_', 'g'),
  '\b[A-Za-z][A-Za-z0-9''’.\-]*\b')) AS words FROM english),
routed AS (SELECT *, CASE WHEN trim(english) = '' THEN 'empty' WHEN contains(lower(english), 'please wait...') THEN 'xfa_placeholder'
  WHEN latin < 120 THEN 'too_few_english_characters' WHEN words < 20 THEN 'too_few_english_words' ELSE 'good' END AS reason FROM counted)"""
)
