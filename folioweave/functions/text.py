"""Text expressions: normalisation, match keys, numbering, titles and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.unicode import nfkc

# Control characters that count as blanks, and characters written otherwise for matching.
BLANKS = r"[\x00\x01\x08\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\s]+"
FOLDED = (("ﬁ", "fi"), ("ﬂ", "fl"), ("–", "-"), ("—", "-"), ("’", "'"), ("“", '"'), ("”", '"'))
LETTER_OR_DIGIT = "[A-Za-z가-힣0-9]"
LETTER = "[A-Za-z가-힣]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(text: Column | str) -> Column:
    """Blanks of every kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), BLANKS, " "))


def lowered(text: Column | str) -> Column:
    return F.lower(normalized(text))


def match_key(text: Column | str) -> Column:
    """Lower-case words and digits only, without leaders and a page number at the end."""
    t = _c(text)
    for a, b in FOLDED:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.lower(normalized(t))
    t = F.regexp_replace(t, r"\.{2,}", " ")
    t = F.regexp_replace(t, r"[\s.·•_=\-]{4,}", " ")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])\d{1,4}\s*$", " ")
    return normalized(F.regexp_replace(t, "[^0-9a-z가-힣]+", " "))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(normalized(text), F.lit("")), F.lit(r"\S+"))


def text_length(text: Column | str) -> Column:
    """Characters that are no blanks."""
    return F.length(F.regexp_replace(_c(text), BLANKS, ""))


def has_content(text: Column | str) -> Column:
    return _c(text).rlike(LETTER_OR_DIGIT)


def text_lines(text: Column | str) -> Column:
    """Normalised lines of a text, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\R|[\x0b\x0c\x1c-\x1e]"), normalized), lambda l: l != "")


def numbering_depth(text: Column | str) -> Column:
    """Depth that a title's own numbering claims, null without numbering.

    A chapter, part or appendix with its number or letter is 1, dotted numbers are as deep as they
    have parts, and a bare number is 1. Roman numerals are no numbering.
    """
    t = normalized(text)
    dotted = F.regexp_extract(t, r"(?U)^(\d+(?:\.\d+)+)\b", 1)
    return (
        F.when(t.rlike(r"(?iU)^(?:(?:chapter|part)\s+\d+\b|제\s*\d+\s*장|appendix\s+[a-z]\b)"), 1)
        .when(dotted != "", F.regexp_count(dotted, F.lit(r"\.")) + 1)
        .when(t.rlike(r"(?U)^\d+\b"), 1)
    )


def ocr_numbering_depth(text: Column | str) -> Column:
    """Depth for OCR statistics: 0 for a bare number, 1 for a chapter word alone, -1 for none, else the number of parts."""
    t = normalized(text)
    number = F.regexp_extract(t, r"(?U)^(\d+(?:\.\d+)*)\b", 1)
    return F.when(is_numeric_only(t), 0).when(t.rlike(r"(?iU)^(?:chapter|part|appendix|제\s*\d+\s*장)\b"), 1).when(number == "", -1).otherwise(F.regexp_count(number, F.lit(r"\.")) + 1)


def is_numeric_only(text: Column | str) -> Column:
    """Digits, blanks, dots and hyphens only, and not blank."""
    return _c(text).rlike(r"(?U)^[\d\s.·\-]+$") & (normalized(text) != "")


def title_shaped(text: Column | str, max_length: int = 160) -> Column:
    t = _c(text)
    return (F.length(t) <= max_length) & t.rlike(LETTER) & (word_count(t) <= 20)


def token_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the token sets of two match keys."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when((a == "") | (b == ""), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def markdown_heading(title: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), title)


# Device names that no file may have.
DEVICES = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])$"


def file_slug(title: Column | str) -> Column:
    """A file name's last part: word characters, dots and hyphens of the compatibility form, at most 64, ``untitled`` if none is left."""
    t = F.regexp_replace(nfkc(_c(title)), r"(?U)[^\w.-]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, "-{2,}", "-"), r"^[ ._-]+|[ ._-]+$", "")
    t = F.regexp_replace(F.substring(F.when(F.coalesce(t, F.lit("")) == "", "untitled").otherwise(t), 1, 64), r"[ .]+$", "")
    return F.when(t.rlike(DEVICES), F.concat(F.lit("_"), t)).otherwise(t)


def node_file_name(order: Column, level: Column, page: Column, title: Column | str) -> Column:
    """Name of a node's file: its place, level, page and slug."""
    return F.concat(F.format_string("%04d_L%d_p%04d_", order, level, page), file_slug(title), F.lit(".md"))


def safe_file_name(name: Column | str) -> Column:
    t = F.trim(F.regexp_replace(normalized(name), r'[<>:"/\\|?*]+', "_"))
    return F.when(t == "", "untitled").otherwise(F.substring(t, 1, 80))


def wiki_link(target: Column, label: Column) -> Column:
    """A link whose label has its backslashes, bars and closing brackets escaped."""
    plain = F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("]"), F.lit("\\]"))
    return F.concat(F.lit("[["), target, F.lit("|"), plain, F.lit("]]"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
