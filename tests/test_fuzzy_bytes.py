"""Edits of bytes as SQL counts them: over every run of whole characters."""

import random

import duckdb
import pytest

from tarnlight.functions import fuzzy
from tarnlight.plans import catalog


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_against_every_run_of_characters(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abéũ\U0001f629日") for _ in range(n))
    for _ in range(120):
        text, pattern = word(rng.randint(0, 12)), word(rng.randint(1, 5))
        best = min(distance(text[i:j].encode(), pattern.encode()) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        for most in (0, 1, 2, 4, 30):
            assert fuzzy.least_byte_errors(text, pattern, most) == (best if best <= most else None)


def test_the_query_equals_its_sql_on_accents(spark, tmp_path):
    con = duckdb.connect()
    texts = ["Enre éelleelleé èvi dans. De enaioiaiç é aielleierle oique.", "abcdéeéeéeéeéeéoéoéoéo", "Été où ça eût plu à tous", "plain words only, of course", None, ""]
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?)", [(i, 0, t) for i, t in enumerate(texts)])
    con.sql(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    want = con.sql(f"SELECT conv_id, turn, errors, score FROM ({catalog.SQL['fuzzy_answers']})").fetchall()
    got = catalog.fuzzy_answers(spark, str(tmp_path)).select("conv_id", "turn", "errors", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
