"""Lines, words and tokens of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines as a line scanner gives them: no empty last line, no trailing carriage return, none for an empty text."""
    cut = F.regexp_replace(F.regexp_replace(text, r"\n\z", ""), r"\r(?=\n|\z)", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(cut, "\n"))


def line_count(text: Column) -> Column:
    return F.size(lines(text)).cast("bigint")


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")).cast("bigint")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, of two characters or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) >= 2)


def snippet(text: Column, n: int = 10) -> Column:
    """The first *n* lines."""
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^\n]*?)</title>", 1))


def html_lang(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z0-9-]+)", 1)


def html_text(html: Column) -> Column:
    """Text without markup: script and style dropped, block ends as line ends, entities of the five kinds resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"(?i)</(p|div|li|tr|h[1-6]|section|article|ul|ol|table|blockquote)\s*>|<br\s*/?>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def xml_root(body: Column) -> Column:
    """The name of the first element."""
    return F.regexp_extract(body, r"<([A-Za-z_][\w.:-]*)", 1)


def json_kind(body: Column) -> Column:
    first = F.substring(F.regexp_replace(body, r"^[\s\x{FEFF}]+", ""), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").otherwise("unknown")
