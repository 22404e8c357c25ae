"""Tokens, normalised text and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"))


def terms(words: Column) -> Column:
    """Single tokens and adjacent pairs joined by a blank."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def lexical_tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))))


def attribute_tokens(text: Column) -> Column:
    """Parts of an attribute value: cut at separators, camel case and digits; lower case; no single signs, no numbers."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"([A-Za-z])(\d)|(\d)([A-Za-z])", "$1$3 $2$4")
    return F.filter(F.split(F.lower(F.regexp_replace(cut, r"[\s_\-]+", " ")), " "), lambda x: (F.length(x) > 1) & ~x.rlike(r"^\d+$"))


def normalised(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def letter_digit_spaced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([A-Za-z])(\d)", "$1 $2"), r"(\d)([A-Za-z])", "$1 $2")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def short_sha1(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, length)


def snippet(text: Column, at: Column, size: Column, around: int = 80) -> Column:
    """Text around a 1-based position, with an ellipsis on each side that is cut."""
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + size + around, F.length(text) + 1)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))


def letter_digit_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"))


def visible(text: Column) -> Column:
    """Without zero-width signs, trimmed."""
    return F.trim(F.translate(text, "\u200b\u200c\u200d\u2060\ufeff", ""))


def compact_data_uri(value: Column) -> Column:
    """A data URI as a marker of its media type ("inline" without one); other values as they are."""
    kind = F.regexp_extract(value, r"^data:([^;,]*)", 1)
    return F.when(value.startswith("data:"), F.concat(F.lit("data:"), F.when(kind == "", "inline").otherwise(kind))).otherwise(value)
