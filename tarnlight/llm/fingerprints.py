"""Document fingerprints by winnowing (operator 4).

DataFrame functions only.  Method: winnowing.  Every run of ``K`` characters is
hashed; of each window of ``W`` consecutive hashes the smallest is chosen, the
rightmost of equal ones, and kept with its position.  Two texts that share
``W + K - 1`` characters share a fingerprint.  A text shorter than that is one
window; one shorter than ``K`` is one hash; an empty or null text has none.

A fingerprint is an array of longs, position * 2**31 + hash, by position.
Texts are worked in chunks of ``CHUNK`` windows, so a long text costs memory
only for its choices.  Likeness is the share of hashes two fingerprints have in
common among all of theirs; of two empty ones it is 1.

Neighbours: rows are dealt by ranges of the document id with bounds from
approximate percentiles; a row whose id is a bound goes to the next range as
well, so every row finds its successor inside its own range with a window over
some tens of rows.  Whole texts are shuffled once.  Rows of equal id follow one
another by text; a null id is smaller than any other.  Rows that repeat have
rows of their own; an empty table gives an empty one.  Other columns are not
looked at.

Every gram is hashed anew, not rolled on from the one before it: array functions
have no running sums, and the forms that were measured cost more (README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 12, 16
SPAN = K + W - 1
CHUNK = 8192
_HASH = (1 << 31) - 1


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _minima(values: Column) -> Column:
    """Smallest value of every window of 16, by two rounds that each take the smallest of four shorter windows."""
    # Past the end there is null, which least() passes over.
    four = lambda v, step: F.transform(v, lambda x, i: F.least(x, F.get(v, i + step), F.get(v, i + 2 * step), F.get(v, i + 3 * step)))
    whole = lambda v: F.slice(v, 1, F.greatest(F.size(v) - (W - 1), F.lit(1)))
    return _let(four(values, 1), lambda v: whole(four(v, 4)))


def _changes(values: Column) -> Column:
    """The values that differ from the one before."""
    return F.filter(values, lambda x, i: ~x.eqNullSafe(F.get(values, i - 1)))


def _chosen(text: Column, base: Column) -> Column:
    """Fingerprint of a chunk of text that stands ``base`` characters from the start."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{K}}}))."), F.lit(1))
    # Hash in the upper half, so that the smallest is found; the later place makes the smaller number.
    ranked = F.transform(runs, lambda g, i: F.shiftleft(F.hash(g).bitwiseAND(F.lit(_HASH)).cast("long"), 32) + (F.lit(_HASH) - i))
    return F.transform(
        _let(_let(ranked, _minima), _changes),
        lambda x: F.shiftleft(base.cast("long") + _HASH - x.bitwiseAND(F.lit(_HASH)), 31) + F.shiftright(x, 32),
    )


def fingerprint(text: Column) -> Column:
    """Fingerprint of whole texts."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - SPAN, F.lit(0)), F.lit(CHUNK))
    # The last window of a chunk begins one place before the next chunk.
    chunks = F.array_distinct(F.flatten(F.transform(starts, lambda a: _chosen(F.substring(text, a + 1, F.lit(CHUNK + SPAN - 1)), a))))
    short = F.array(F.hash(text).bitwiseAND(F.lit(_HASH)).cast("long"))
    return F.when(n.isNull() | (n == 0), F.array().cast("array<long>")).when(n < K, short).otherwise(chunks)


def _within(fp: Column, upto: Column) -> Column:
    """The choices of windows that lie inside the first ``upto`` characters.

    A choice is first made by the window that it enters, if it is no larger
    than the choice before it, or else by the window that leaves that one behind.
    """
    place = lambda x: F.shiftright(x, 31)
    hashed = lambda x: x.bitwiseAND(F.lit(_HASH))

    def first(x: Column, i: Column) -> Column:
        last = F.get(fp, i - 1)
        return F.when(i == 0, F.lit(0)).when(hashed(x) <= hashed(last), place(x) - (W - 1)).otherwise(place(last) + 1)

    return F.filter(fp, lambda x, i: first(x, i) <= upto - SPAN)


def _moved(fp: Column, by: Column) -> Column:
    return F.transform(fp, lambda x: x + F.shiftleft(by.cast("long"), 31))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two fingerprints as a share of all of theirs."""
    hashes = lambda fp: F.array_distinct(F.transform(fp, lambda x: x.bitwiseAND(F.lit(_HASH))))
    return _let(
        F.struct(hashes(a).alias("a"), hashes(b).alias("b")),
        lambda s: _let(
            F.size(F.array_intersect(s["a"], s["b"])),
            lambda n: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)).otherwise(n / (F.size(s["a"]) + F.size(s["b"]) - n)),
        ),
    )


def successors(docs: DataFrame, rows_in_range: int = 50, most_ranges: int = 65_536) -> DataFrame:
    """``docs(id, text)`` with ``fp`` and, from the next row by descending id (after the last, the first), ``next_text`` and ``next_fp``.

    The bounds are one literal of ``most_ranges`` longs at most.
    """
    rows = docs.count()
    if not rows:
        return docs.select("id", "text", fingerprint(F.col("text")).alias("fp"), F.lit(None).cast("string").alias("next_text"), F.array().cast("array<long>").alias("next_fp"))
    n = max(1, min(most_ranges, rows // rows_in_range))
    shares = [i / n for i in range(1, n)]
    got = docs.agg(F.max("id").alias("top"), *([F.percentile_approx("id", shares, max(10_000, 4 * n)).alias("cuts")] if shares else [])).first()
    top = got["top"]
    cuts = sorted({c for c in (got["cuts"] if shares else []) if c < top})
    bounds = F.lit(cuts) if cuts else F.array().cast("array<long>")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))

    def halve(s: Column, _: Column) -> Column:  # the number of bounds below the id, by bisection
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        open_ = s["lo"] < s["hi"]
        above = F.get(bounds, mid) < F.col("id")
        return F.struct(F.when(open_ & above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~above, mid).otherwise(s["hi"]).alias("hi"))

    place = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda s: s["lo"])
    d = docs.withColumn("r", place)
    again = F.array_compact(
        F.array(
            F.struct(F.col("r").alias("r"), F.lit(0).alias("again")),
            F.when(F.get(bounds, F.col("r")) == F.col("id"), F.struct((F.col("r") + 1).alias("r"), F.lit(1).alias("again"))),
            F.when(F.col("id") == top, F.struct(F.lit(0).alias("r"), F.lit(1).alias("again"))),
        )
    )
    d = d.withColumn("at", F.explode(again)).select("id", "text", "at.r", "at.again").repartition("r")
    d = d.withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("r").orderBy("again", F.desc("id"), "text")
    d = d.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
    return d.where("again = 0").select("id", "text", "fp", "next_text", "next_fp")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its fingerprint, its edited text, and the fingerprint of that.

    The edited text is the first half (the longer) followed by as many
    characters of the next document as the second half has, or all it has.
    Its fingerprint is put together from the windows inside the two parts,
    which both documents have already, and those across the seam.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(text_col).alias("text"))
    d = successors(d)
    d = d.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)))
    d = d.withColumn("c", F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int"))
    d = d.withColumn("m", F.least(F.col("n_chars") - F.col("c"), F.coalesce(F.length("next_text"), F.lit(0))))
    d = d.withColumn("edited", F.concat(F.coalesce(F.left("text", F.col("c")), F.lit("")), F.when(F.col("m") > 0, F.left("next_text", F.col("m"))).otherwise(F.lit(""))))
    side = SPAN - 1
    back = F.greatest(F.col("c") - side, F.lit(0))
    seam = F.substring("edited", back + 1, F.lit(2 * side) - F.greatest(F.lit(side) - F.col("c"), F.lit(0)))
    d = d.withColumn("seam", F.when((F.col("c") > 0) & (F.col("m") > 0), _moved(fingerprint(seam), back)).when(F.col("c") + F.col("m") < SPAN, fingerprint(F.col("edited"))).otherwise(F.array().cast("array<long>")))
    parts = F.concat(_within(F.col("fp"), F.col("c")), F.col("seam"), _moved(_within(F.col("next_fp"), F.col("m")), F.col("c")))
    d = d.withColumn("edited_fp", F.array_sort(F.array_distinct(parts)))
    return d.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited", "fp", "edited_fp", "next_fp")


def digest(fp: Column) -> Column:
    return F.md5(F.array_join(fp.cast("array<string>"), ","))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_chosen)``."""
    d = edits(docs, id_col, text_col)
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("fp")).alias("fingerprint"),
        digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.size("fp").alias("n_chosen"),
    )
