"""Column helpers for names, labels, dates and free text."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F

# Patterns, lengths and word lists the results depend on.
WORD = r"[\p{L}\p{N}_]+"
TYPE_PREFIX = r"(?i)^\[(PERSON|ORGANIZATION|OBJECT|LOCATION|EVENT)\]\s+"
LIST_SEPARATOR = "<SEP>"
ISO_DASH = r"\b(\d{4})-(\d{2})-(\d{2})\b"
ISO_SLASH = r"\b(\d{4})/(\d{2})/(\d{2})\b"
MONTH_FIRST = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
UUID_PREFIX = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_(?=.)"
LABEL_SEPARATORS = r"[\s:;,\-–—]+"
ARTICLE = r"(?:the|a|an)\s+"
NON_FACTS = ["unknown", "n/a", "none", "not available", "insufficient evidence"]
DESCRIBED_TYPES = ["event", "communication", "document", "asset"]
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once per row, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Trims all Unicode white space; much cheaper per row than a pattern."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeeze(c: Column) -> Column:
    """All white space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def pick_text(*candidates: Column) -> Column:
    """First candidate that is not blank."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in candidates])


def clip(c: Column, limit: int) -> Column:
    """Texts over the limit are cut and end with an ellipsis inside the limit."""
    cut = F.rtrim(F.substring(c, 1, limit - 3), F.lit(WHITE_SPACE))
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("..."))).otherwise(c)


def first_sentence(c: Column, limit: int) -> Column:
    text = squeeze(c)
    sentence = F.regexp_replace(text, r"(?s)^(.*?[.!?]) .*$", "$1")
    return F.when(text != "", clip(sentence, limit))


def prefixed_type(label: Column) -> Column:
    """The bracketed type in front of a label, lower case, or null."""
    found = F.lower(F.regexp_extract(label, TYPE_PREFIX, 1))
    return F.when(label.startswith("[") & (found != ""), found)


def without_type(label: Column) -> Column:
    return F.when(label.startswith("["), F.regexp_replace(label, TYPE_PREFIX, "")).otherwise(label)


def split_packed(c: Column) -> Column:
    """A packed id list: the long separator wins over the comma; UNKNOWN and blanks drop out."""
    raw = strip(c)
    parts = F.when(raw.contains(LIST_SEPARATOR), F.split(raw, LIST_SEPARATOR)).otherwise(F.split(raw, ","))
    cleaned = F.transform(parts, strip)
    return F.coalesce(F.filter(cleaned, lambda p: (p != "") & (p != "UNKNOWN")), F.array().cast("array<string>"))


def source_tokens(c: Column) -> Column:
    """The value itself and its parts under each separator on its own."""
    pieces = [
        F.when(c.contains(sep), F.filter(F.transform(F.split(c, pattern), strip), lambda p: p != ""))
        for sep, pattern in ((LIST_SEPARATOR, LIST_SEPARATOR), (",", ","), (";", ";"), ("|", r"\|"))
    ]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(c), *[F.coalesce(p, none) for p in pieces]))


def first_date(c: Column) -> Column:
    """First valid date in the text as yyyy-mm-dd; only the first match of each pattern counts."""

    def month_first(found: Column) -> Column:
        def padded(parts: Column) -> Column:
            year = parts[2].try_cast("int")
            pivoted = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
            iso = F.concat_ws("-", F.lpad(pivoted.cast("string"), 4, "0"), F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"))
            return F.try_to_date(iso, "yyyy-MM-dd")

        return F.when(found != "", bind(F.split(found, "[/-]"), padded))

    # coalesce stops at the first hit, so later patterns cost nothing where an earlier one matched
    found = F.coalesce(
        F.try_to_date(F.nullif(F.regexp_extract(c, ISO_DASH, 0), F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(F.regexp_extract(c, ISO_SLASH, 0), F.lit("")), "yyyy/MM/dd"),
        bind(F.regexp_extract(c, MONTH_FIRST, 0), month_first),
    )
    return F.when(c.rlike(r"\d[-/]\d"), found.cast("string"))


def clean_description(description: Column, label: Column) -> Column:
    """Drops a repeated leading label ("X: X is ..."), with or without articles."""
    return clean_stripped(strip(description), strip(label))


def clean_stripped(text: Column, name: Column) -> Column:
    """clean_description() of columns that are stripped already; they are mentioned often, so they should be plain columns."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    plain = F.concat(F.lit("(?diU)^"), quoted, F.lit(f"{LABEL_SEPARATORS}((?:{ARTICLE})?"), quoted, F.lit(r"\b.*)$"))
    articled = F.concat(F.lit(f"(?diU)^{ARTICLE}"), quoted, F.lit(f"{LABEL_SEPARATORS}({ARTICLE}"), quoted, F.lit(r"\b.*)$"))
    return (
        F.when(text == "", F.lit(None))
        .when(F.coalesce(name, F.lit("")) == "", text)
        .when(F.lower(text).startswith(F.lower(name)), _extracted_or_whole(text, plain))
        .when(text.rlike(f"(?i)^{ARTICLE}"), _extracted_or_whole(text, articled))
        .otherwise(text)
    )


def _extracted_or_whole(text: Column, pattern: Column) -> Column:
    found = F.call_function("regexp_extract", text, pattern, F.lit(1))
    return F.coalesce(F.nullif(found, F.lit("")), text)


def usable_summary(*candidates: Column) -> Column:
    """First filled description; raw extraction lines (tabs and newlines) are no description."""
    text = pick_text(*candidates)
    return F.when(~(text.contains("\t") & text.contains("\n")), text)


def relation_type_text(record: dict[str, Column], content: Column) -> Column:
    """Relation wording: the first filled field, else the first tab field of the content."""
    named = pick_text(record["keywords"], record["relation_type"], record["type"], record["label"])
    filled = blank_to_null(content)
    tabbed = F.when(filled.contains("\t"), F.split(filled, "\t", 2)[0])
    return F.coalesce(named, blank_to_null(tabbed))


def relation_label(description: Column, content: Column, relation: Column, src: Column, tgt: Column) -> Column:
    lines = F.filter(F.transform(F.split(content, r"\r\n|\n|\r"), strip), lambda l: l != "")
    from_content = F.when(F.size(lines) >= 3, F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n")).when(
        F.size(lines) > 0, F.element_at(lines, -1)
    )
    return F.coalesce(description, from_content, relation, F.concat(src, F.lit(" -> "), tgt))


def text_key(c: Column) -> Column:
    """Matching key of a name: no type tag, lower case letters and digits, single blanks."""
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^\[[A-Z_]+\]\s*", "")
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), "[^a-z0-9]+", " "))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_key(path: Column) -> Column:
    return text_key(F.regexp_replace(base_name(path), UUID_PREFIX, ""))


def slug(c: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(cleaned == "", F.lit("case")).otherwise(cleaned)


def fact_value(c: Column) -> Column:
    """A fact text of at most 500 characters; stock phrases for "not known" become null."""
    text = clip(blank_to_null(c), 500)
    return F.when(~F.lower(strip(text)).isin(NON_FACTS), text)


FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.IGNORECASE | re.DOTALL)


def _json_object(text: str | None) -> str | None:
    """The first place in a fenced part, else in the text, where a whole JSON object can be read."""
    decoder = json.JSONDecoder()
    for part in [*FENCE.findall(text or ""), text or ""]:
        at = part.find("{")
        while at >= 0:
            try:
                return part[at:decoder.raw_decode(part, at)[1]]
            except (ValueError, RecursionError):
                at = part.find("{", at + 1)
    return None


def first_json_object(c: Column) -> Column:
    """The JSON object in a text that may wrap it in prose or a fence; null if there is none.

    Where an object ends is only known by reading it, which no column function reports, so this is an Arrow batch.
    """

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        return column.map(_json_object)

    return read(c)


def descriptive_name(entity_type: Column, description: Column) -> Column:
    """First useful description segment as the name of an event, communication, document or asset."""
    kind = F.lower(strip(F.coalesce(entity_type, F.lit(""))))
    segments = F.split(F.replace(description, F.lit(LIST_SEPARATOR), F.lit("\n")), r"\r\n|\n|\r")

    def tidy(segment: Column) -> Column:
        text = F.regexp_replace(squeeze(segment), r"[ .;,:\-\t]+$", "")
        bare = F.when(kind == "document", text).otherwise(F.regexp_replace(text, r"(?i)^(?:the|a|an)\s+", ""))
        return strip(bare)

    def useful(name: Column) -> Column:
        placeholder = name.rlike(r"(?i)^(event|communication|document|asset)_\d+$")
        return (name != "") & ~placeholder & ~F.lower(name).isin(DESCRIBED_TYPES)

    found = F.try_element_at(F.filter(F.transform(segments, tidy), useful), F.lit(1))
    named = F.concat(F.upper(F.substring(found, 1, 1)), F.substr(found, F.lit(2)))
    return F.when(kind.isin(DESCRIBED_TYPES), named)


def _unmark(c: str) -> str:
    return unicodedata.normalize("NFC", "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d)[0] != "M"))


@cache
def _unmarked() -> tuple[str, str]:
    """Letters with marks and what is left of them without, in all scripts; at the end the marks, which are left out."""
    pairs, marks = [], []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
            continue
        plain = _unmark(c)
        if plain != c and len(plain) == 1:
            pairs.append((c, plain))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(p for _, p in pairs)


def fold_latin(c: str) -> str:
    """What fold() makes of a character of Latin-1, which has no marks of their own."""
    return _unmark(c.lower())


def fold(c: Column) -> Column:
    """Lower case without diacritics of any script, as the search index compares words."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *_unmarked())).otherwise(low)


def rough_tokens(c: Column) -> Column:
    """Words and single marks; 0 for a blank text, else at least 1."""
    text = strip(F.coalesce(c, F.lit("")))
    n = F.regexp_count(text, F.lit(WORD + r"|[^\p{L}\p{N}_\s]"))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), n))


def distinct_ignoring_case(values: Column) -> Column:
    """Array without blanks and without later repeats of the same lower-case text."""
    cleaned = F.filter(F.transform(values, strip), lambda v: v != "")
    keyed = F.transform(cleaned, lambda v: F.struct(F.lower(v).alias("key"), v.alias("text")))

    def firsts(pairs: Column) -> Column:
        return bind(
            F.transform(pairs, lambda p: p["key"]),
            lambda keys: F.transform(F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1), lambda p: p["text"]),
        )

    return bind(keyed, firsts)
