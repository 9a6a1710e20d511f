"""Delete runs of lines that stand earlier in the corpus (operator 1).

Method: winnowing over line hashes.  A run of lines counts if it has
``min_lines`` lines or ``min_words`` words.  The window of a line is the
shortest run from it that counts; of each window the smallest line hash, the
rightmost of equal ones, is chosen and kept with its position.  Equal windows
choose the same line, so two places that share a run that counts share a chosen
hash at the same place of the run: a guaranteed fingerprint.

Positions are joined by fingerprint; those whose fingerprint stands nowhere else
are left out.  From a chosen line matches are extended both ways as far as the
next fingerprint does not take over: to every run around it that counts, has at
most ``min_lines`` lines and is no union of shorter ones.  A run longer than that
is the union of such runs, since each of its lines lies in one of them.  So a
line goes exactly if it lies in a run that counts, of any length, all of whose
lines stand one after the other at an earlier place too: the matches between a
place and every earlier one, extended until lines differ.  That is the
definition of ``SQL``.

Lines end at line feeds; they are compared without ASCII white space at their
ends.  Blank lines are no lines here: they never count and always stay.  Null
and empty texts have no lines and stay as they are.  A null id is smaller than
any other.  Rows with equal id and line are one position: neither of them is
earlier; runs found in one text of an id go from rows of that text only.  A text
of any length is worked in one pass over its lines.  An empty table gives an
empty one.  Other columns of the input, whatever their names, come back
unchanged from ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import free, over_salts, salt, slices, stored

MIN_LINES, MIN_WORDS = 3, 50
_BLANK = " \t\r\x0b\x0c"
_CHOSEN = "id long, t long, k int, fp long, runs array<struct<w1:long,w2:long,a:int,z:int>>"
_RUN = pa.struct([("w1", pa.int64()), ("w2", pa.int64()), ("a", pa.int32()), ("z", pa.int32())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def winnowed(h: list[bytes], many: list[int], min_lines: int, min_words: int) -> dict[int, list[tuple[int, int]]]:
    """Chosen lines of a text with hashes ``h`` and ``many`` words: the runs (first, last line) around each."""
    n, out = len(h), {}
    z, total = -1, 0  # the window of the line before ends here
    for a in range(n):
        if z < a:
            z, total = a, many[a]
        while total < min_words and z - a + 1 < min_lines and z + 1 < n:
            z += 1
            total += many[z]
        if total < min_words and z - a + 1 < min_lines:
            break
        least = min(h[a : z + 1])
        k = next(i for i in range(z, a - 1, -1) if h[i] == least)
        runs = out.setdefault(k, [])
        runs.append((a, z))
        rest = total - many[a]  # words from the next line on: with enough of them the next line has this run's end too
        for e in range(z + 1, min(a + min_lines, n)):
            rest += many[e]
            if rest >= min_words:
                break
            runs.append((a, e))
        total -= many[a]
        while z > a + 1 and total - many[z] >= min_words:  # the next window may end earlier
            total -= many[z]
            z -= 1
        if z - a >= min_lines:
            total -= many[z]
            z -= 1
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int) -> DataFrame:
    """``(id, t, k, fp, runs)``: hash of the text, place and hash of each chosen line, and hash, first and last line of the runs around it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line_hash, run_hash = xxhash.xxh3_64_digest, xxhash.xxh3_128_intdigest
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for i, text, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = [x for x in ((text or "").split("\n")) if x]
                lines = [x.encode() for x in (y.strip(_BLANK) for y in lines) if x]
                h = [line_hash(x) for x in lines]
                for k, runs in winnowed(h, [len(x.split()) for x in lines], min_lines, min_words).items():
                    hashed = [(run_hash(b"".join(h[a : z + 1])), a, z) for a, z in runs]
                    made = [(_signed(x >> 64), _signed(x & (1 << 64) - 1), a, z) for x, a, z in hashed]
                    for column, x in zip(out, (i, t, k, _signed(int.from_bytes(h[k], "big")), made)):
                        column.append(x)
            sizes = [0]
            for runs in out[4]:
                sizes.append(sizes[-1] + len(runs))
            flat = list(zip(*(r for runs in out[4] for r in runs))) or [()] * 4
            struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _RUN)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct)], names=["id", "t", "k", "fp", "runs"])

    picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))
    return picked.mapInArrow(work, _CHOSEN)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, t, runs)``: the runs of each document, by id and hash of the text, that stand earlier in the corpus.

    A fingerprint or run of a third of all lines is dealt to ``SALTS`` tasks, in
    counting and in the joins back; only one row for each of its salts meets in a window.
    """
    every = stored(fingerprints(docs, id_col, text_col, min_lines, min_words), "lines").withColumn("salt", salt("id", "t", "k"))
    shared = over_salts(every, ["fp"], n=(F.sum, F.count("*"))).where("n > 1").select("fp", "salt")
    matched = every.join(shared, ["fp", "salt"]).select("id", "t", "salt", F.explode("runs").alias("run")).select("id", "t", "salt", "run.*")
    place = F.struct("id", "a")
    first = over_salts(matched, ["w1", "w2"], n=(F.sum, F.count("*")), first=(F.min, F.min(place))).where("n > 1").drop("n")
    later = matched.join(first, ["w1", "w2", "salt"]).where(place > F.col("first"))
    return later.groupBy("id", "t").agg(F.collect_set(F.struct("a", "z")).alias("runs"))


def _applied(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    name, text = free(docs, "__key"), free(docs, "__text_hash")
    found = found.select(F.col("id").alias(name), F.col("t").alias(text), F.col("runs").alias(free(docs, "__runs")))
    return docs.withColumn(name, key).withColumn(text, F.xxhash64(F.col(text_col))).join(found, [name, text], "left").drop(name, text)


def strip_runs(text: str | None, runs: list | None) -> tuple[str | None, int, int]:
    """The text without the lines of ``runs``, its number of lines that are not blank, and how many went."""
    if text is None:
        return None, 0, 0
    gone = {k for r in runs or () for k in range(r["a"], r["z"] + 1)}
    kept, n = [], 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            if n not in gone:
                kept.append(line)
            n += 1
        else:
            kept.append(line)
    return "\n".join(kept), n, len(gone)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from the text.

    With ``report`` also ``__n_lines`` and ``__n_removed`` (lines that are not blank).
    """
    joined = _applied(docs, id_col, text_col, repeats(docs, id_col, text_col, min_lines, min_words))
    at, schema = docs.columns.index(text_col), docs.schema
    if report:
        schema = type(schema)([*schema.fields]).add("__n_lines", "long").add("__n_removed", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs = b.column(b.num_columns - 1)
            texts, n, gone = b.column(at).to_pylist(), [0] * b.num_rows, [0] * b.num_rows
            for i, r in enumerate(runs.to_pylist()):
                if r or report:
                    texts[i], n[i], gone[i] = strip_runs(texts[i], r)
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            columns[at] = pa.array(texts, pa.string())
            names = b.schema.names[:-1]
            if report:
                columns, names = [*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "__n_lines", "__n_removed"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(work, schema)


#: The same in DuckDB's SQL, for at least 3 lines or 50 words: a longer run is the union of its runs of at most 3 lines.
SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), lines AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k,
         trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM raw WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), ahead AS (
  SELECT *, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2, lead(w, 1) OVER o AS w1
  FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), runs AS (
  SELECT doc_id, k, 1 AS n, t AS run FROM ahead WHERE w >= 50
  UNION ALL
  SELECT doc_id, k, 2, t || chr(10) || t1 FROM ahead WHERE w + w1 >= 50
  UNION ALL
  SELECT doc_id, k, 3, t || chr(10) || t1 || chr(10) || t2 FROM ahead WHERE t2 IS NOT NULL
), later AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS nth FROM runs
), gone AS (
  SELECT DISTINCT doc_id, k + unnest(range(n)) AS k FROM later WHERE nth > 1
), kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text
  FROM raw r LEFT JOIN lines l ON r.doc_id = l.doc_id AND r.i = l.i
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k
  WHERE g.k IS NULL GROUP BY r.doc_id
)
SELECT d.doc_id,
       coalesce((SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id), 0) AS n_lines,
       coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
