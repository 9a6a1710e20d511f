import random

from pyspark.sql import functions as F

from tarnlight.llm import lines


def matched(docs: list[list[str]], words: dict[str, int], least: int) -> set[tuple[int, int]]:
    """Every line of every match with an earlier place, extended both ways until lines differ."""
    places = [(d, k) for d, own in enumerate(docs) for k in range(len(own))]
    gone = set()
    for d, k in places:
        for e, j in places:
            if (e, j) >= (d, k) or docs[e][j] != docs[d][k]:
                continue
            a, z = k, k
            while a > 0 and j - (k - a) > 0 and docs[d][a - 1] == docs[e][j - (k - a) - 1]:
                a -= 1
            while z + 1 < len(docs[d]) and j + z - k + 1 < len(docs[e]) and docs[d][z + 1] == docs[e][j + z - k + 1]:
                z += 1
            if z - a + 1 >= least or sum(words[x] for x in docs[d][a : z + 1]) >= 50:
                gone.add((d, k))
    return gone


def test_against_brute_force(spark):
    rng = random.Random(1)
    for least in (1, 2, 3, 5):
        words = {c: rng.choice([1, 3, 10, 24, 26, 49, 50, 60]) for c in "abcdef"}
        text = {c: " ".join([c] * n) for c, n in words.items()}
        docs = [[rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(25)]
        rows = [(d, "\n".join(text[c] for c in own), d) for d, own in enumerate(docs)]
        gone = matched(docs, words, least)
        got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, salt int"), min_lines=least).collect()
        assert {r.doc_id: r.text for r in got} == {d: "\n".join(text[c] for k, c in enumerate(own) if (d, k) not in gone) for d, own in enumerate(docs)}


def test_windows_choose_the_rightmost_smallest():
    assert lines.winnowed([b"b", b"a", b"a", b"c"], [1] * 4, 3, 50) == {2: [(0, 2), (1, 3)]}
    assert lines.winnowed([b"b", b"a"], [60, 1], 3, 50) == {0: [(0, 0), (0, 1)]}
    assert lines.winnowed([], [], 3, 50) == lines.winnowed([b"a"], [1], 3, 50) == {}


def test_a_match_goes_on_behind_its_window(spark):
    long = "w " * 60
    docs = spark.createDataFrame([(1, f"{long}\nend"), (2, f"{long}\nother"), (3, f"x\n{long}\nend\ny")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == {1: f"{long}\nend", 2: "other", 3: "x\ny"}


def test_one_line_in_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot line " * 30)).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    got = lines.dedup(docs, report=True)
    assert got.where("__n_removed > 0").count() == 999 and got.count() == 3000
