"""Hide facts in long contexts and score what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions.text import tokens


def grid(spark, lengths: list[int], depths: list[float]) -> DataFrame:
    """Every pair of a length and a depth; both are short lists of a configuration."""
    a = spark.createDataFrame([(int(x),) for x in lengths], "context_length int")
    return a.crossJoin(spark.createDataFrame([(float(x),) for x in depths], "depth_percent double"))


def _sizes(text: Column, mark: str) -> Column:
    """Lengths of the parts of a text that end at a mark."""
    parts = F.split(F.regexp_replace(text, mark, "$0\u0001"), "\u0001")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.length(p))


def sentence_sizes(text: Column) -> Column:
    """Lengths of the parts that end behind . ! ? before white space, or at a line feed; null for null."""
    return _sizes(text, r"[.!?](?=\s)|\n")


def inject(haystack: Column, needle: Column, depth_percent: Column) -> Column:
    """The haystack with the needle at the boundary nearest to a depth in per cent.

    Boundaries: start, end, behind . ! ? before white space, line feeds; where
    there is none inside, ends of words.  The earliest of equally near ones.
    """

    def nearest(h: Column, sizes: Column) -> Column:
        """One pass over the sizes of the parts: the end of a part, inside the text, that is nearest to the goal."""
        n, goal = h["n"], h["goal"]

        def step(s: Column, size: Column) -> Column:
            upto = s["upto"] + size
            better = (upto < n) & (upto > 0) & (F.abs(upto - goal) < s["off"])
            return F.struct(upto.alias("upto"), F.when(better, F.abs(upto - goal)).otherwise(s["off"]).alias("off"), F.when(better, upto).otherwise(s["at"]).alias("at"))

        first = F.struct(F.lit(0).alias("upto"), goal.alias("off"), F.lit(0).alias("at"))
        return F.aggregate(sizes, first, step, lambda s: F.when(F.abs(n - goal) < s["off"], n).otherwise(s["at"]))

    def placed(h: Column) -> Column:
        at = F.when(F.size(h["marks"]) > 1, nearest(h, h["marks"])).otherwise(nearest(h, h["words"]))
        return F.transform(F.array(at), lambda p: F.concat_ws(" ", F.filter(F.array(F.trim(F.left(h["text"], p)), h["needle"], F.trim(F.substring(h["text"], p + 1, h["n"]))), lambda x: x != "")))[0]

    def bound(t: Column) -> Column:
        n = F.length(t)
        return F.struct(t.alias("text"), needle.alias("needle"), n.alias("n"), (n * depth_percent / 100).cast("double").alias("goal"), sentence_sizes(t).alias("marks"), _sizes(t, r"\S+(?=\s)").alias("words"))

    return F.transform(F.transform(F.array(haystack), bound), placed)[0]


def sample(haystack: Column, needle: Column, context_length: Column, depth_percent: Column) -> Column:
    """A context of ``context_length`` tokens, the haystack repeated or trimmed, with the needle in it."""
    w = tokens(haystack)
    room = F.greatest(context_length - F.size(tokens(needle)), F.lit(0))
    times = F.ceil(room / F.greatest(F.size(w), F.lit(1))).cast("int")
    body = F.array_join(F.slice(F.flatten(F.array_repeat(w, times)), F.lit(1), room), " ")
    return F.when((F.size(w) == 0) | (room == 0), needle).otherwise(inject(body, needle, depth_percent))
