"""Every stage of the pipeline against SQL, the library or a plain version, each on what its predecessor kept."""

import hashlib
import math

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tarnlight.llm import lines, mixing, neardup, queries, toxicity
from tarnlight.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    """The table before the first stage and after each."""
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def over(df, sql: str):
    """SQL over a table of the pipeline, by document."""
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con.sql(sql).fetchall()


def test_order_and_columns(spark, made):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dups", "source_mix", "bpe"]
    assert all(d.columns == made[0].columns for d in made[:-1])
    assert rows(corpus_pipeline.run(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == rows(made[-1], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_toxicity_by_every_pair_of_terms(spark, made):
    model = toxicity.train(made[0], table(spark, SF, "labels"))
    place = {b: i for i, b in enumerate(model.known.tolist())}

    def score(text: str | None) -> float:
        own = sorted({place[b] for w in (text or "").split() for b in map(toxicity.bucket, toxicity.terms_of(w)) if b in place})
        margin = model.w0 + sum(model.w[i] for i in own) + sum(model.v[i] @ model.v[j] for k, i in enumerate(own) for j in own[k + 1 :])
        return 1 / (1 + math.exp(-margin))

    kept = [r for r in made[0].collect() if score(r.text) < 0.5]
    assert sorted(map(repr, kept)) == sorted(map(repr, made[1].collect()))


def test_line_dedup_by_sql(made):
    want = {i: sha for i, sha in over(made[1], f"SELECT doc_id, kept_sha256 FROM ({lines.SQL})")}
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in made[2].collect()}
    assert got == want and rows(made[1], "doc_id", "lang", "source") == rows(made[2], "doc_id", "lang", "source")


def test_near_dups_by_sql(made):
    want = {i for i, kept in over(made[2], f"SELECT doc_id, kept FROM ({neardup.SQL})") if kept}
    assert sorted(map(repr, made[3].collect())) == sorted(repr(r) for r in made[2].collect() if r.doc_id in want)


def test_source_mix_by_sql(made):
    size = {i: (n, taken) for i, n, taken in over(made[3], f"SELECT doc_id, size, taken FROM ({mixing.SQL})")}
    of = {r.doc_id: r for r in made[3].collect()}
    want = [repr(of[i]) for i, (n, taken) in size.items() if n for _ in range(taken // n)]
    got = [repr(r) for r in made[4].collect() if size[r.doc_id][0]]
    assert sorted(got) == sorted(want)


def test_bpe_by_the_library(made):
    library = Tokenizer.from_file(queries.byte_bpe())
    want = []
    for r in made[4].select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append(repr((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())))
    assert rows(made[5], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_odd_rows_pass_every_stage(spark):
    odd = [(1, "a b c", None, "x"), (1, "a b c", None, "x"), (None, None, "s", "y"), (2, "", "s", None), (3, "w " * 20000, "s", "z"), (4, "é\n\n日 <|endoftext|>", "t", "q")]
    docs = spark.createDataFrame([(i, t, s, k, 7, 8) for i, t, s, k in odd], "doc_id long, text string, source string, key string, salt int, rep long")
    for table_ in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            table_ = stored(stage(spark, table_, SF), name)
            assert name == "bpe" or table_.columns == docs.columns
    assert docs.count() == 6
