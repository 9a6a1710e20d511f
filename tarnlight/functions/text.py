"""Text functions as Column expressions; nothing here leaves the JVM, but for ``answer_found`` with errors allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and the underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Unicode white space, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text, duplicates kept; of null, none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Tokens between white space, case kept; of null, none."""
    return F.coalesce(F.filter(F.split(text, SPACE), lambda x: x != ""), F.array().cast("array<string>"))


def keyword_overlap(query: Column, text: Column) -> Column:
    """Distinct lower-case tokens that both have."""
    return F.size(F.array_intersect(tokens(F.lower(query)), tokens(F.lower(text))))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's tokens found, in [0, 1], to three places."""
    return F.round(F.least(keyword_overlap(query, text) / F.greatest(F.size(tokens(query)), F.lit(1)), F.lit(1.0)), 3)


def containment(part: Column, whole: Column) -> Column:
    """Share of the distinct words of ``part`` that ``whole`` has; 0 without words."""
    own = F.array_distinct(words(part))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, words(whole))), F.size(own)), F.lit(0.0))


def preview(text: Column, size: int = 160) -> Column:
    return F.substring(F.translate(text, "\n", " "), 1, size)


def label(text: Column, size: int = 28) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def stem(path: Column) -> Column:
    """File name without its folder and its last suffix."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def sentences(text: Column) -> Column:
    """Spans that end at . ! or ? before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def answer_found(prediction: Column, truth: Column, fuzzy: bool = True, error_rate: float = 0.0) -> Column:
    """1.0 if the prediction has the truth in it (fuzzy) or equals it; 0.0 otherwise and for an empty truth.

    With an ``error_rate`` a fuzzy match may be off by so many edits for each character of the truth.
    """
    if fuzzy and error_rate:
        from tarnlight.functions.fuzzy import found

        return found(prediction, truth, error_rate)
    p, t = F.lower(F.trim(prediction)), F.lower(F.trim(truth))
    hit = F.contains(p, t) if fuzzy else prediction == truth
    return F.when(F.coalesce(hit & (t != ""), F.lit(False)), 1.0).otherwise(0.0)
