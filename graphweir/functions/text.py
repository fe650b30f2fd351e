"""Text expressions: all JVM-side columns, no Python in the row path.

White space is the explicit class of space, tab, line feed, carriage return and
form feed, so that regular expression dialects agree. Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f]+"
EDGES = r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"
CONTROLS = r"[\x00-\x1f\x7f-\x9f]"
#: HTML entities that cleaning undoes; the ampersand last (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Values that read as true (fixed values).
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def words(c: Column) -> Column:
    """The words of a text, as an array; none for blank and null texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANKS), lambda x: x != "")


def phrase(c: Column) -> Column:
    """A phrase in lower case with all but ASCII letters, digits and spaces blanked, trimmed of spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^A-Za-z0-9 ]", " "))


def split_markers(c: Column, markers: list[str]) -> Column:
    """Parts between any of the markers, trimmed, without empty ones."""
    import re

    pattern = "|".join(re.escape(m) for m in markers) if markers else "$^"
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean(c: Column) -> Column:
    """Trimmed, HTML entities undone, control characters dropped."""
    return F.regexp_replace(unescape(strip(c)), CONTROLS, "")


def is_float(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def slug(c: Column) -> Column:
    """The last path part in lower case, runs of other characters as one underscore."""
    last = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUE_WORDS), F.lit(False))


def json_body(c: Column) -> Column:
    """The widest {...} of a text on one line; null where there is none."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.regexp_replace(body, r"[\r\n]+", " "))


def blocks(c: Column, tag: str) -> Column:
    """The trimmed bodies of <tag>...</tag> blocks."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), 1), strip)


def fenced(c: Column, language: str = "") -> Column:
    """The trimmed bodies of ``` fenced blocks."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)```{language}[^\n`]*\n(.*?)```"), 1), strip)


def after_last(c: Column, mark: str) -> Column:
    return strip(F.substring_index(c, mark, -1))


def without(c: Column, parts: list[str]) -> Column:
    """A response cleaned of given substrings, such as the prompt and role marks."""
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return strip(c)


def normalize_answer(c: Column, articles_first: bool = True) -> Column:
    """Lower case without articles and punctuation, blanks squeezed.

    ``articles_first`` decides the order of the two removals: with articles
    first, those that marks bound (``a.``) go too; else only whole words.
    """
    punctuation = r"[!-/:-@\[-`{-~]"
    low = F.lower(c)
    if articles_first:
        low = F.regexp_replace(F.regexp_replace(low, r"(?U)\b(a|an|the)\b", " "), punctuation, "")
        return F.array_join(words(low), " ")
    return F.array_join(F.filter(words(F.regexp_replace(low, punctuation, "")), lambda w: ~w.isin("a", "an", "the")), " ")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")
