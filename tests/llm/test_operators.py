import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnlight.llm import bpe, fingerprints, html, lines, mixing, neardup, queries, substrings, token_store, toxicity, vectors
from tarnlight.llm.common import connected_components

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "x  y\n\n z <|endoftext|> é"), (5, "w " * 20000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 2 else "s", "extra", 1) for i, t in ODD], "doc_id long, text string, source string, id string, `__id` int")


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_source_mix", "op6_vector_dups"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    expected = con.sql(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, expected))


def test_bpe_and_token_store_against_the_library(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.byte_bpe())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in ODD}
    for r in bpe.round_trip(odd, queries.byte_bpe()).collect():
        e = ids[r.doc_id]
        assert r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()
    path = token_store.scratch_path(spark)
    token_store.write_ids(odd, queries.byte_bpe(), path)
    got = sorted(token_store.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 5]
    assert all(r.ids_crc32 == zlib.crc32(np.array([*ids[r.doc_id], 0], "<u4").tobytes()) for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


@pytest.mark.parametrize("high", [1, 2, 2**16, 2**33, 2**60, 2**63])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(0)
    for n in (0, 1, 61, 1023, 1025, 4000):
        v = rng.integers(0, high, n).astype(np.uint64)
        assert (token_store.unpack(*token_store.pack(v), n) == v).all()


def test_toxicity_learns_and_defines_empty_cases(spark, odd):
    rows = [(i, ("you idiot " if i % 3 == 0 else "hello ") + f"word{i % 7}", int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.predictions(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got) and sum(r.held_out for r in got) > 20
    empty = toxicity.train(odd, labels.limit(0))
    assert toxicity.score(odd, empty).count() == len(ODD) and toxicity.keep_clean(odd, toxicity.train(docs, labels)).columns == odd.columns


def test_lines(spark, odd):
    a = "one\ntwo\nthree"
    docs = spark.createDataFrame([(1, a), (2, "zero\n" + a + "\n\nfour"), (3, "one\ntwo"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert got == {1: a, 2: "zero\n\nfour", 3: "one\ntwo", 4: None}
    assert lines.dedup(odd).columns == odd.columns and lines.dedup(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got) and sum(r.taken for r in got) <= sum(r.size for r in got)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


def test_near_dups_against_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 200)]
    texts = [" ".join(base), " ".join([*base[:190], "x", *base[191:]]), " ".join(base[:100]), "a b", "a b", "a c", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}
    assert neardup.keep_one(odd).columns == odd.columns


@pytest.mark.parametrize("hot", [1500, 1])
def test_substrings_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    p = word(450)
    texts = [word(300) + p + word(100), p + word(50), word(900), "ab" * 500, None, "", p[:399]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for k in range(len(r) - 399):
            seen[r[k : k + 400]] = seen.get(r[k : k + 400], 0) + 1
    for row in substrings.dedup(docs).collect():
        r = raw[row.doc_id]
        gone = {q for k in range(len(r) - 399) if seen[r[k : k + 400]] > 1 for q in range(k, k + 400)}
        assert bytes(row.kept) == bytes(x for i, x in enumerate(r) if i not in gone) and row.n_removed == len(gone)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, 0.1], None)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_dups(v).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and all(got[k] == (0, k) for k in range(3, 9))


def test_html():
    page = "<html><nav>menu</nav><header>h</header><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one<br>two <p> three<script>x</script></article><div id='comments'>no</div><footer>f</footer>"
    assert html.main_text(page) == "A & B\n\none two\n\nthree"
    assert html.main_text(None) == html.main_text("") == ""


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (None, 1)], "src long, dst long")
    assert {r.id: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


LONG = " ".join(["The main text of this page goes on for a good while."] * 8)


def test_html_unmarked_text_competes_with_marked_regions():
    teaser = "<article class='card'><a href='/x'>Read more</a></article>"
    story = f"<div class='story'><p>{LONG}</p><p>{LONG}</p></div>"
    assert html.main_text(f"<body>{teaser}{story}</body>") == f"{LONG}\n\n{LONG}"
    assert html.main_text(f"<body>{story}{teaser * 3}</body>") == f"{LONG}\n\n{LONG}"
    # An article is whole, and what is short beside it is no main text.
    page = f"<body><div>By someone</div><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></article><div>Read on</div></body>"
    assert html.main_text(page) == f"Head\n\n{LONG}\n\n{LONG}\n\nEnd."


def test_html_keeps_whole_regions_of_unmarked_pages():
    body = f"<h1>Head</h1><p>{LONG}</p><ul><li>one</li><li>two</li></ul><p>Short.</p><p>{LONG}</p><p>End.</p>"
    whole = f"Head\n\n{LONG}\n\none\n\ntwo\n\nShort.\n\n{LONG}\n\nEnd."
    around = "<body><nav>menu</nav><div class='top'><a href='/'>Home</a> <a href='/a'>About</a></div>%s<div class='ad'>buy</div><footer>f</footer></body>"
    for page in (body, f"<div>{body}</div>", f"<section><div>{body}</div></section>", f"<div class='layout with-sidebar'><div class='sidebar'>side</div><div>{body}</div></div>", f"<article class='review'>{body}</article>", f"<div class='no-sidebar legal-text'>{body}</div>"):
        assert html.main_text(around % page) == whole
    comments = f"<article><p>{LONG}</p></article><div id='comments'><p>{LONG}</p><p>{LONG}</p></div>"
    assert html.main_text(around % comments) == LONG
    assert html.main_text("<body><div class='ad'>Buy this and that today.</div><div><h1>A b</h1><p>c d</p></div></body>") == "A b\n\nc d"
    assert html.main_text("<div class='x-menu'><div>a" * 3000 + f"<p>{LONG}").endswith(LONG)


def test_lines_of_one_text_stay_in_others_of_its_id(spark):
    a, own = "one\ntwo\nthree", "p\nq\nr\ns"
    texts = [(None, a), (None, "zero\n" + a), (None, own), (5, a), (5, own + "\nt"), (5, a), (6, "k\nl\nm\nn")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.n: r.text for r in lines.dedup(docs).collect()}
    assert got == {0: a, 1: "zero", 2: own, 3: "", 4: "t", 5: "", 6: "k\nl\nm\nn"}


def test_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(map(chr, rng.integers(97, 100, n)))
    texts = [word(n) for n in (1, 11, 12, 13, 26, 27, 28, 53, 54, 55, 200, 8192, 8218, 8219)] + ["ab" * 60, "", None]
    rows = [*enumerate(texts), (3, word(40)), (3, word(30)), (None, word(70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (-(-(2**63) if r[0] is None else r[0]), r[1] is not None, r[1] or ""))
    expected = []
    for k, (i, text) in enumerate(order):
        t, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) - len(t) // 2
        expected.append((i, t, t[:half] + after[: len(t) - half]))
    grams = sorted({x[k : k + 12] for _, t, e in expected for x in (t, e) for k in range(max(1, len(x) - 11))})
    hashed = {r.g: r.h & (2**31 - 1) for r in spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.hash("g").alias("h")).collect()}

    def brute(x: str) -> list[int]:
        h = [hashed[x[k : k + 12]] for k in range(max(1, len(x) - 11))] if x else []
        windows = [range(a, min(a + 16, len(h))) for a in range(max(1, len(h) - 15))] if h else []
        return sorted({p << 31 | h[p] for w in windows for p in [min(w, key=lambda q: (h[q], -q))]})

    got = [(r.doc_id, r.edited, r.fp, r.edited_fp) for r in fingerprints.edits(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, e, brute(t), brute(e))) for i, t, e in expected)
