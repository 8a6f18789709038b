"""Text columns: tokens, words, phrases, terms and snippets.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str`` methods see it; Java's ``\s`` is narrower.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_']"
#: Words that don't make an anchor on their own.
STOPWORDS = "the and or to of a in for on with at by an be is".split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, ``_`` and ``'``."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD}+)"), 1), F.lower)


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, f"{WS}+"), lambda x: x != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse(text: Column) -> Column:
    """Trimmed, each run of white space as one space."""
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def normal_term(text: Column) -> Column:
    return F.lower(collapse(text))


def capitalised_phrases(text: Column, most: int = 6) -> Column:
    """Runs of capitalised words of at most ``most`` words, repeats kept."""
    one = r"[A-Z][a-zA-Z0-9\-']+"
    found = F.regexp_extract_all(text, F.lit(rf"(?U)\b({one}(?:\s+{one})*)\b"), 1)
    return F.filter(found, lambda x: F.size(words(x)) <= most)


def head_terms(title: Column, short: int = 4) -> Column:
    w = words(title)
    return F.when(F.size(w) <= short, title).otherwise(F.array_join(F.slice(w, 1, 4), " "))


def tail_terms(title: Column, short: int = 4) -> Column:
    w = words(title)
    return F.when(F.size(w) <= short, title).otherwise(F.array_join(F.slice(w, F.size(w) - 2, F.lit(3)), " "))


def escaped(term: Column) -> Column:
    """A term as a literal in a regular expression."""
    return F.regexp_replace(term, r"([^\p{L}\p{N}_ ])", r"\\$1")


def term_pattern(term: Column) -> Column:
    """The term in any case, not inside a longer ASCII word."""
    return F.concat(F.lit("(?iu)(?<![A-Za-z0-9_])"), escaped(term), F.lit("(?![A-Za-z0-9_])"))


def snippet(text: Column, start: Column, end: Column, reach: int = 45) -> Column:
    """``reach`` characters on both sides of [start, end), trimmed and collapsed."""
    lo = F.greatest(start - reach, F.lit(0))
    return collapse(F.substring(text, lo + 1, end + reach - lo))


def truncated(text: Column, most: int = 240) -> Column:
    """At most ``most`` characters, the last an ellipsis where text was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def excerpt(text: Column, most: int = 1000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), f"{WS}+$", ""), F.lit("…"))).otherwise(text)


def paragraphs(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")


def paragraph_html(text: Column) -> Column:
    return F.array_join(F.transform(paragraphs(text), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")


def valid_phrase(text: Column, variant: Column) -> Column:
    """Phrases behind entity, brand and tag anchors have one to five words, others two to seven
    of which one is no stop word."""
    w = words(text)
    rest = F.exists(w, lambda x: ~F.lower(x).isin(STOPWORDS))
    return F.when(variant.isin("entity", "brand", "tag"), (F.size(w) >= 1) & (F.size(w) <= 5)).otherwise((F.size(w) >= 2) & (F.size(w) <= 7) & rest)


def valid_anchor(text: Column, variant: Column) -> Column:
    """Entity, brand and tag anchors are one word and no stop word; others two to seven words, not stop words only."""
    w = words(text)
    rest = F.exists(w, lambda x: ~F.lower(x).isin(STOPWORDS))
    return F.when(variant.isin("entity", "brand", "tag"), (F.size(w) == 1) & rest).otherwise((F.size(w) >= 2) & (F.size(w) <= 7) & rest)
