"""Markup removal and the portable segmentation as column expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rules of markup removal, in order. Literals first, then patterns (Java dialect) with replacements.
MARKUP_LITERALS = (("&gt;", ">"), ("&lt;", "<"), ("&quot;", ""), ("'''''", ""), ("'''", ""), ("''", ""))
MARKUP_PATTERNS = (
    (r"(?md)^\s*[*#:;]+[^\n]*$", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{\|[^}]*\|\}", ""),
    (r"(?d)\[\[(:?(File|Category|Media):[^\]]*).*\]\]", ""),
    (r"\[\[#?([^\]|]*)\]\]", "$1"),
    (r"\[\[#?[^|]*\|([^\]]*)\]\]", "$1"),
    (r"===== ([^=]+) =====", ""),
    (r"==== ([^=]+) ====", ""),
    (r"=== ([^=]+) ===", ""),
    (r"== ([^=]+) ==", ""),
    (r"= ([^=]+) =", ""),
    (r"<!--[^-]*-->", ""),
    (r"(?md)^\-+$", ""),
    (r"<small[^>]*>([^<]*)</small>", "$1"),
    (r"<big[^>]*>([^<]*)</big>", "$1"),
    (r"<blockquote[^>]*>([^<]*)</blockquote>", "$1"),
    (r"<poem[^>]*>([^<]*)</poem>", "$1"),
    (r"<[^>]*>[^<]*</[^>]*>", ""),
    (r"<[^/]*/>", ""),
)
#: The portable profile, the same in Java's dialect and RE2.
SENTENCE_BREAK = r"[.!?]+[ \t\n\f\r]+|\n+"
HAS_WORD = r"[\p{L}\p{N}]"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def strip_markup(text: Column) -> Column:
    """Wiki markup removed by an ordered chain of replacements. The order matters, and no rule is special-cased: three list lines
    leave the two line feeds between them."""
    for old, new in MARKUP_LITERALS:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, new in MARKUP_PATTERNS:
        text = F.regexp_replace(text, pattern, new)
    return text


#: Named preprocessors of whole document texts; an unknown name means none.
PREPROCESSORS: dict[str, Callable[[Column], Column]] = {"wikitext::strip_markup": strip_markup}


def preprocess(text: Column, name: str | None) -> Column:
    return PREPROCESSORS.get(name or "", lambda c: c)(text)


def sentences(text: Column) -> Column:
    """Portable profile: pieces between sentence marks followed by white space, or line feeds, that hold a letter or digit."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: s.rlike(HAS_WORD))


def words(sentence: Column) -> Column:
    """Portable profile: runs of letters and digits, and single other characters that aren't white space. Case is kept."""
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))
