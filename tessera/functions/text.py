"""Scalar text functions as column expressions: tokenizers, clipping, slugs, first sentences, lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about what is looked for.
STOP_WORDS = (
    "a an and are as at be by can could do does done for from get gets has have how i "
    "if in into is it its me my of on or should so that the their them then there "
    "these this to use used uses using was what when where which who why will with "
    "work works working would you your happen happens happening explain tell show "
    "code file function method class project app"
).split()
#: Suffixes of the small stemmer with what replaces them, tried in order.
SUFFIXES = (("ies", "y"), ("ied", "y"), ("ing", ""), ("es", ""), ("s", ""), ("ed", ""))
WORD = "[A-Za-z][A-Za-z0-9]*"
CAMEL = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def plain(expression: str) -> str:
    """The expression as SQL's engine (RE2) reads it: word boundaries of ASCII words, white space without the vertical tab, lines that end at \\n alone. Java's
    own boundaries know letters of all scripts, so a keyword beside one wouldn't be found."""
    out = re.sub(r"\\\\|\\b|\\s", lambda m: {"\\b": _EDGE, "\\s": r"[\t\n\f\r ]"}.get(m[0], m[0]), expression)
    return "(?d)" + out


def stem(term: Column) -> Column:
    """The first suffix that fits and leaves three characters is replaced."""
    out = term
    for suffix, other in reversed(SUFFIXES):
        cut = F.concat(F.substring(term, F.lit(1), F.length(term) - len(suffix)), F.lit(other))
        out = F.when(term.endswith(suffix) & (F.length(term) - len(suffix) >= 3), cut).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Identifiers split at case changes, lower case, without stop words and single letters, stemmed."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(CAMEL), F.lit(0))))
    kept = F.filter(F.transform(parts, F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))
    return F.transform(kept, stem)


def tokens_raw(text: Column) -> Column:
    """Identifiers in lower case, each followed by its parts between underscores: a plain word comes twice."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(F.split(w, "_"), lambda p: p != ""))))


def tokens_parts(text: Column) -> Column:
    """Parts of identifiers without a plural s (not of ss, over three letters), each followed by the part itself if cut."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(words, lambda w: F.split(w, "_"))), lambda p: p != "")
    cut = lambda p: (F.length(p) > 3) & p.endswith("s") & ~p.endswith("ss")
    return F.flatten(F.transform(parts, lambda p: F.when(cut(p), F.array(F.substring(p, F.lit(1), F.length(p) - 1), p)).otherwise(F.array(p))))


def lines(text: Column) -> Column:
    """Lines at \\n, without the empty one after a final line end."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def full_lines(text: Column) -> Column:
    """How many lines hold more than white space."""
    return F.size(F.filter(lines(text), lambda x: F.trim(x) != "")).cast("long")


def clip(text: Column, size: int) -> Column:
    """White space runs to one space, trimmed; longer texts end in an ellipsis within `size`."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…")))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, question or exclamation mark that white space or the end follows."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    found = F.regexp_extract(flat, r"^(.*?[.!?])( |$)", 1)
    return F.when(found != "", found).otherwise(flat)


def slug(text: Column, size: int = 40) -> Column:
    """Lower case, other than letters and digits to single hyphens, at most `size`, no hyphen at an end."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(flat, "^-+", ""), 1, size), "-+$", "")
    return F.when(cut == "", F.lit("note")).otherwise(cut)
