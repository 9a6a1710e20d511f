"""Contexts of an exact length in the tokens of a pluggable tokenizer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the tokens of a text begin and end, in characters.
Offsets = Callable[[str], list[tuple[int, int]]]
_MARKS, _WORDS = re.compile(r"[.!?](?=\s)|\n"), re.compile(r"\S+(?=\s)")
_SPACE = re.compile(r"[^\s\x1c-\x1f\x85]+")
#: Cuts of a haystack that are tried for one context.
TRIES = 24


def space_tokens(model: str | None = None) -> Offsets:
    """Tokens between white space."""
    return lambda text: [m.span() for m in _SPACE.finditer(text)]


def library_tokens(model: str | None = None) -> Offsets:
    """A tokenizer of the tokenizers library, from its JSON file, without special tokens."""
    from tokenizers import Tokenizer

    if not model:
        raise ValueError("a file is needed")
    t = Tokenizer.from_file(model)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).offsets


#: Tokenizers by name; each is called with a model, once in a Python worker.
TOKENIZERS: dict[str, Callable[[str | None], Offsets]] = {"space": space_tokens, "tokenizers": library_tokens}


@lru_cache(maxsize=4)
def _loaded(factory: Callable[[str | None], Offsets], model: str | None) -> Offsets:
    return factory(model)


def place(body: str, needle: str, depth_percent: float) -> str:
    """``needle`` in ``body`` at the boundary nearest to a depth, as ``needles.inject`` puts it."""
    n = len(body)
    ends = [m.end() for m in _MARKS.finditer(body) if m.end() < n] or [m.end() for m in _WORDS.finditer(body)]
    goal, spots = n * depth_percent / 100, [0, *ends, n]
    i = bisect_left(spots, goal)
    near = [s for s in spots[max(0, i - 1) : i + 1]]
    at = min(near, key=lambda s: (abs(s - goal), s))
    return " ".join(x for x in (body[:at].strip(" "), needle, body[at:].strip(" ")) if x)


def fitted(haystack: str, needle: str, size: int, depth_percent: float, offsets: Offsets) -> tuple[str, int]:
    """A context of ``size`` tokens and how many it has: the haystack, repeated or cut at the edge of a token, with the needle in it.

    Tokens may merge where parts meet, so the number of tokens of the whole
    context decides: the cut moves by what is missing until it is right.  Where
    no edge gives exactly ``size``, as where a character is several tokens, cuts
    between the characters behind the best edge are tried, and the same without the
    first few characters; then the longest context below is taken.  A needle
    that fills the context, and one without a haystack, stands alone.
    """
    own = len(offsets(needle))
    if own >= size or not haystack.strip():
        return needle, own
    one = offsets(haystack)
    body = " ".join([haystack] * (-(-size // max(1, len(one))) + 1))
    edges = [0, *(z for _, z in offsets(body))]
    many, seen, best, cut = size - own, set(), (needle, own), 0
    for _ in range(TRIES):
        many = min(max(many, 0), len(edges) - 1)
        if many in seen:
            break
        seen.add(many)
        made = place(body[: edges[many]], needle, depth_percent)
        n = len(offsets(made))
        if n == size:
            return made, n
        if best[1] < n < size or (n < size and best[0] is needle):
            best, cut = (made, n), edges[many]
        many += size - n
        if many in seen:  # between two cuts that were tried
            many = next((x for x in (many - 1, many + 1) if x not in seen), many)
    ends = range(cut + 1, min(cut + TRIES, len(body)) + 1)
    for first, at in [*((0, x) for x in ends), *((f, x) for f in range(1, 9) for x in range(max(f, cut - 3), min(cut + 9, len(body)) + 1))]:
        made = place(body[first:at], needle, depth_percent)
        n = len(offsets(made))
        if n == size:
            return made, n
        best = (made, n) if best[1] < n < size else best
    return best


def contexts(rows: DataFrame, tokenizer: str | Callable[[str | None], Offsets] = "space", model: str | None = None) -> DataFrame:
    """``rows(haystack, needle, context_length, depth_percent)`` with ``context`` and ``n_tokens``, its length in the tokenizer's tokens; null texts count as empty."""
    if isinstance(tokenizer, str) and tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    factory = TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer

    @F.pandas_udf("context string, n_tokens int")
    def made(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        offsets = _loaded(factory, model)
        for batch in batches:
            got = [fitted(h or "", n or "", int(size), float(depth), offsets) for h, n, size, depth in zip(*batch)]
            yield pd.DataFrame(got, columns=["context", "n_tokens"])

    both = rows.withColumn("__made", made("haystack", "needle", "context_length", "depth_percent"))
    return both.select(*rows.columns, "__made.context", "__made.n_tokens")
