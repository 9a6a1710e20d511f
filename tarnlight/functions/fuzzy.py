"""Approximate substrings, in Arrow batches: how few edits make a truth appear in an answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def least_errors(text: str, pattern: str) -> int:
    """Fewest insertions, deletions and substitutions that turn some substring of ``text``, the empty one too, into ``pattern``.

    Myers' bit-parallel columns of the edit table with Sellers' start row, in
    which a match may begin anywhere; an integer holds a whole column, so a
    character of the text costs a few operations whatever the pattern's length.
    """
    m = len(pattern)
    if not m or pattern in text:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, errors, best = every, 0, m, m  # cells of a column that are one above, or one below, the cell before
    for c in text:
        eq = at.get(c, 0)
        over = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(diagonal | up) & every, up & diagonal
        errors += bool(right & last) - bool(left & last)
        best = min(best, errors)
        right, left = right << 1 & every, left << 1 & every
        up, down = left | ~(over | right) & every, right & over
    return best


def least_byte_errors(text: str, pattern: str, most: int) -> int | None:
    """The same in edits of UTF-8 bytes, between ``pattern`` and runs of whole characters; None if there are more than ``most``.

    Runs of bytes that begin or end inside a character need no more edits, so
    their fewest are a bound, and only texts within it get a table, in which a
    match begins and ends at a character.
    """
    if text.isascii() and pattern.isascii():
        low = least_errors(text, pattern)
        return low if low <= most else None
    raw, goal = text.encode(), pattern.encode()
    if least_errors(raw.decode("latin-1"), goal.decode("latin-1")) > most:
        return None
    row = list(range(len(goal) + 1))
    best = row[-1]
    for at, c in enumerate(raw, 1):
        new = [row[0] + 1]
        for i, p in enumerate(goal, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        if at == len(raw) or raw[at] & 0xC0 != 0x80:  # a character ends, the next may begin a match
            best = min(best, new[-1])
            new = [min(x, i) for i, x in enumerate(new)]
        row = new
    return best if best <= most else None


@F.pandas_udf(IntegerType())
def _byte_errors(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, patterns, most in batches:
        yield pd.Series([None if t is None or not p else least_byte_errors(t, p, int(n)) for t, p, n in zip(texts, patterns, most)], dtype="Int32")


def byte_errors(prediction: Column, truth: Column, rate: float) -> Column:
    """Fewest edits of bytes between the truth and a part of the prediction, if they are ``allowed``; null otherwise.  As SQL engines count that know bytes only."""
    return _byte_errors(F.lower(F.trim(prediction)), F.lower(F.trim(truth)), F.coalesce(allowed(truth, rate), F.lit(0)))


@F.pandas_udf(IntegerType())
def _errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, patterns in batches:
        yield pd.Series([None if t is None or not p else least_errors(t, p) for t, p in zip(texts, patterns)], dtype="Int32")


def errors(prediction: Column, truth: Column) -> Column:
    """Fewest edits between the truth and a part of the prediction, both without case and outer spaces; null for a null text or an empty truth."""
    return _errors(F.lower(F.trim(prediction)), F.lower(F.trim(truth)))


def allowed(truth: Column, rate: float) -> Column:
    """Edits that a truth may be off by at a rate of errors a character, rounded down."""
    if not 0 <= rate < 1:
        raise ValueError("a rate of errors is at least 0 and below 1")
    return F.floor(F.length(F.trim(truth)) * F.lit(rate) + F.lit(1e-9)).cast("int")


def found(prediction: Column, truth: Column, rate: float) -> Column:
    """1.0 if the prediction has the truth in it but for ``rate`` edits a character; 0.0 otherwise, and for an empty truth."""
    return F.when(F.coalesce(errors(prediction, truth) <= allowed(truth, rate), F.lit(False)), 1.0).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _share(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lists, patterns, most in batches:
        out = []
        for texts, p, n in zip(lists, patterns, most):
            texts = [] if texts is None else list(texts)
            hits = sum(1 for t in texts if p and t is not None and least_errors(t, p) <= n)
            out.append(hits / len(texts) if texts else 0.0)
        yield pd.Series(out, dtype="float64")


def share_found(texts: Column, truth: Column, rate: float) -> Column:
    """Share of a list of texts that have the truth in them but for ``rate`` edits a character."""
    return _share(F.transform(texts, lambda t: F.lower(F.trim(t))), F.lower(F.trim(truth)), F.coalesce(allowed(truth, rate), F.lit(0)))
