import math

import pytest

from tarnlight.operators import answers, bm25, chunking, dense, metrics, needles, overlap, reshape
from tarnlight.operators import stats
from tarnlight.operators.generation import Decoding, Generator, causal
from tarnlight.operators.retrievers import Dense, Okapi, Retriever
from tarnlight.plans import answering, runner, settings
from tarnlight.plans.settings import Settings
from tarnlight.schemas import DEPTHS, LENGTHS, Benchmark
from tarnlight.sources import readers, writers
from tarnlight.streaming import ingest
from pyspark.sql import functions as F


def docs(spark, *texts):
    return bm25.from_lists(spark, list(texts), [f"d{i}" for i in range(len(texts))])


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_bm25_matching_document_first_then_corpus_order(spark):
    got = bm25.top_k(docs(spark, "red apple pie", "blue sky above", "green grass grows"), asked(spark, "apple pie red"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["d0", "d1"] and got[1].score == 0


def test_bm25_common_term_has_negative_idf_floored(spark):
    got = bm25.top_k(docs(spark, "x a", "x b", "x c", "x d"), asked(spark, "x"), 3).collect()
    assert len(got) == 3


def test_bm25_empty(spark):
    assert bm25.top_k(docs(spark, "a b"), asked(spark, "?!"), 3).count() == 0
    assert bm25.top_k(spark.createDataFrame([], "doc_id string, text string, ord long"), asked(spark, "a"), 3).count() == 0
    with pytest.raises(ValueError):
        bm25.from_lists(spark, ["a"], ["1", "2"])
    with pytest.raises(ValueError):
        bm25.top_k(docs(spark, "a"), asked(spark, "a"), 0)


def test_chunks(spark):
    d = spark.createDataFrame([("a", "w " * 600), ("b", "w " * 1000), ("c", ""), ("d", "two words"), ("e", None)], "doc_id string, text string")
    got = [r.chunk_id for r in chunking.chunks(d).orderBy("chunk_id").collect()]
    assert got == ["a::0", "a::1", "b::0", "b::1", "b::2", "d::0"]
    with pytest.raises(ValueError):
        chunking.chunks(d, 5, 5)


def test_dense(spark):
    index = spark.createDataFrame([("a::0", "a", "x", [1.0, 0.0]), ("b::0", "b", "y", [0.0, 1.0])], "chunk_id string, doc_id string, text string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.chunk_id for r in dense.top_k(index, q, 2).orderBy("rank").collect()] == ["a::0", "b::0"]
    with pytest.raises(ValueError):
        Dense(dense.Embedder(), None)
    with pytest.raises(TypeError):
        Dense(dense.Embedder(), object())
    with pytest.raises(ValueError):
        dense.Embedder("no such")


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0), ("other", "a", 1.0)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "b", 0), ("q", "c", 2), ("unseen", "a", 1)], "query_id string, doc_id string, relevance int")
    r = {x.query_id: x for x in metrics.per_query(run, qrels, [1, 3]).collect()}
    assert set(r) == {"q", "unseen"}
    assert r["q"]["precision@1"] == 1 and abs(r["q"]["precision@3"] - 2 / 3) < 1e-9 and r["q"]["mrr"] == 1 and r["unseen"]["mrr"] == 0
    assert abs(r["q"]["ndcg@3"] - (1 + 2 / math.log2(4)) / (2 + 1 / math.log2(3))) < 1e-9


def test_pooling_takes_the_best_chunk(spark):
    run = spark.createDataFrame([("q", "d1", 0.4), ("q", "d1", 0.9), ("q", "d2", 0.5), ("q", "d3", float("nan"))], "query_id string, doc_id string, score double")
    assert {r.doc_id: r.score for r in metrics.pooled(run).collect()} == {"d1": 0.9, "d2": 0.5}


def small(spark):
    qrels = spark.createDataFrame([("q0", "d0", 1)], "query_id string, doc_id string, relevance int")
    return Benchmark(docs(spark, "red apple pie", "blue sky above", "green grass grows"), asked(spark, "apple pie"), qrels)


def test_benchmark_run_and_csv(spark, tmp_path):
    data = small(spark)
    wanted = Settings(retrievers=("bm25", "overlap", "dense", "dense:trigram"), out=str(tmp_path / "r" / "out.csv"), index_folder=str(tmp_path / "cache"))
    table = {r.retriever: r for r in runner.run(spark, wanted, data=data).collect()}
    assert table["bm25"]["mrr"] == 1.0 and set(table) == set(wanted.retrievers)
    back = readers.results(spark, str(tmp_path / "none.csv"), wanted.out)
    assert back.count() == 4 and back.columns[0] == "retriever" and readers.results(spark, str(tmp_path / "none.csv")) is None
    assert len(list((tmp_path / "cache").iterdir())) == 2
    with pytest.raises(ValueError):
        runner.build(spark, data, Settings(retrievers=("no such",)))
    with pytest.raises(ValueError):
        runner.runs({}, data.queries, 1)
    with pytest.raises(TypeError):
        runner.runs({"x": object()}, data.queries, 1)


def test_retrievers_can_be_given(spark):
    class Fixed:
        def retrieve(self, queries, k):
            return queries.select("query_id", F.lit("d0").alias("doc_id"), F.lit(1.0).alias("score"))

    assert isinstance(Fixed(), Retriever) and not isinstance(object(), Retriever)
    got = runner.run(spark, Settings(cutoffs=(1,)), {"fixed": Fixed(), "bm25": Okapi(small(spark).corpus)}, small(spark)).collect()
    assert {r.retriever: r["precision@1"] for r in got} == {"fixed": 1.0, "bm25": 1.0}


def test_an_index_belongs_to_its_corpus_and_encoder(spark, tmp_path):
    texts = lambda c, e: {r.text for r in runner.cached_index(spark, c, e, str(tmp_path)).collect()}
    a, b, words = docs(spark, "one"), docs(spark, "two"), dense.Embedder("hash")
    assert texts(a, words) == {"one"} and texts(b, words) == {"two"} and texts(a, words) == {"one"}
    assert texts(a, dense.Embedder("trigram")) == {"one"} and texts(a, dense.Embedder("hash", "16")) == {"one"}
    assert len(list(tmp_path.iterdir())) == 3  # one for each encoder, which follows its corpus
    runner.cached_index(spark, a, words, str(tmp_path), "other")
    assert len(list(tmp_path.iterdir())) == 4


def test_settings_argument_then_environment_then_default(monkeypatch):
    assert settings.resolve("encoder") == "hash"
    monkeypatch.setenv("TARNLIGHT_ENCODER", "trigram")
    assert settings.resolve("encoder") == "trigram" and settings.resolve("encoder", "md5") == "md5" and settings.resolve("encoder", "") == "trigram"
    monkeypatch.setenv("TARNLIGHT_ENCODER", "")
    got = runner.parse_args(["--source", "x", "--retrievers", "bm25", "--cutoffs", "1", "2"])
    assert (got.encoder, got.retrievers, got.cutoffs, got.out) == ("hash", ("bm25",), (1, 2), None)
    task, got = answering.parse_args(["answers", "--source", "x", "--temperature", "0.5"])
    assert (task, got.temperature, got.passages, got.generator) == ("answers", 0.5, 4, "echo")
    with pytest.raises(SystemExit):
        answering.parse_args([])


def test_command_lines_over_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"1","text":"The key is brass."}\n{"_id":"2","text":"Fish swim."}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q","text":"what is the key"}\n')
    (tmp_path / "answers.jsonl").write_text('{"_id":"q","answer":"brass"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    out = str(tmp_path / "out" / "a.csv")
    got = answering.run(spark, *answering.parse_args(["answers", "--source", str(tmp_path), "--retrievers", "bm25", "--out", out])).first()
    assert got.answer_correctness == 1.0 and readers.results(spark, out).count() == 1
    (tmp_path / "hay.txt").write_text("Some words here. " * 30)
    (tmp_path / "n.json").write_text('[{"text":"The key is brass.","question":"What is the key?","answer":"brass"}]')
    (tmp_path / "n.csv").write_text("text,question,answer\nThe key is brass.,What is the key?,brass\n")
    for needle in ("n.json", "n.csv"):
        got = answering.run(spark, *answering.parse_args(["needles", "--source", str(tmp_path / "hay.txt"), "--needles", str(tmp_path / needle), "--max-new-tokens", "100000"])).collect()
        assert len(got) == 35 and all(r.score == 1.0 for r in got)
    found = runner.first_results(readers.collection(spark, str(tmp_path))).collect()
    assert [(r.rank, r.doc_id) for r in found] == [(1, "1"), (2, "2")] and found[0].preview == "The key is brass."
    with pytest.raises(ValueError):
        answering.run(spark, "no such", Settings())


def test_generators(spark):
    prompts = spark.createDataFrame([("Context:\n[1] one two three\n\nQuestion",), (None,)], "prompt string")
    write = lambda how: {r.answer for r in Generator("echo", how=how).generate(prompts).collect()}
    assert write(None) == {"one two three", "I don't know."} and write(Decoding(max_new_tokens=2)) == {"one two", "I don't know."}
    own = Generator(lambda model, how: lambda texts: [f" {model} {how.temperature} " for _ in texts], "m", Decoding(temperature=0.5))
    assert {r.answer for r in own.generate(prompts).collect()} == {"m 0.5"}
    assert write(Decoding(stops=(" th", "two"))) == {"one", "I don't know."}
    for wrong in ({"max_new_tokens": 0}, {"temperature": -1.0}, {"top_p": 0.0}, {"stops": ("",)}, {"batch": 0}):
        with pytest.raises(ValueError):
            Decoding(**wrong)
    with pytest.raises(ValueError):
        Generator("no such")


def fake_transformers(monkeypatch, template: str | None, gpu: bool):
    """A library whose model answers each prompt with its number of real tokens; every character is a token."""
    import sys
    import types
    from contextlib import nullcontext

    import numpy as np

    calls = types.SimpleNamespace(batches=[], options=[], device=[], special=[])

    class Padded(dict):
        def to(self, device):
            calls.device.append(device)
            return self

    class Tokenizer:
        chat_template, pad_token, eos_token, pad_token_id = template, None, "</s>", 0

        def apply_chat_template(self, asked, tokenize, add_generation_prompt):
            return template.format(asked[0]["content"])

        def __call__(self, texts, return_tensors, padding, add_special_tokens):
            calls.batches.append(texts)
            calls.special.append(add_special_tokens)
            width = max(map(len, texts))
            mask = np.array([[0] * (width - len(t)) + [1] * len(t) for t in texts])
            return Padded(input_ids=mask * 5, attention_mask=mask)

        def batch_decode(self, ids, skip_special_tokens):
            return [f" saw {int(row[0])}; and more" for row in ids]

    class Net:
        def to(self, device):
            calls.device.append(device)
            return self

        def eval(self):
            return self

        def generate(self, input_ids, attention_mask, **options):
            calls.options.append(options)
            return np.concatenate([input_ids, attention_mask.sum(axis=1)[:, None]], axis=1)

    auto = lambda thing: types.SimpleNamespace(from_pretrained=lambda model, **options: thing)
    monkeypatch.setitem(sys.modules, "torch", types.SimpleNamespace(inference_mode=nullcontext, cuda=types.SimpleNamespace(is_available=lambda: gpu)))
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(AutoTokenizer=auto(Tokenizer()), AutoModelForCausalLM=auto(Net())))
    return calls


def test_causal_models_work_in_batches_padded_in_front(monkeypatch):
    calls = fake_transformers(monkeypatch, None, gpu=True)
    prompts = ["aaaaaaa", "b", "cccc", "dd", "eeeee"]
    assert causal("m", Decoding(batch=2))(prompts) == [f" saw {len(p)}; and more" for p in prompts]
    assert calls.batches == [["b", "dd"], ["cccc", "eeeee"], ["aaaaaaa"]] and set(calls.device) == {"cuda"} and all(calls.special)
    assert calls.options[0] == {"max_new_tokens": 256, "do_sample": False, "pad_token_id": 0}


def test_causal_models_sample_with_a_temperature_use_chat_templates_and_stop(monkeypatch):
    calls = fake_transformers(monkeypatch, "<u>{}</u>", gpu=False)
    assert causal("m", Decoding(5, 0.7, 0.9, (";", "more")))(["p"]) == [" saw 8"] and causal("m", Decoding())([]) == []
    assert calls.batches == [["<u>p</u>"]] and not any(calls.special) and set(calls.device) == {"cpu"}
    assert calls.options == [{"max_new_tokens": 5, "do_sample": True, "temperature": 0.7, "top_p": 0.9, "pad_token_id": 0}]
    with pytest.raises(ValueError):
        causal(None, Decoding())


def test_text_folder_and_stream(spark, tmp_path):
    for name, text in (("a.txt", "one\r\ntwo"), ("b.md", "three"), ("c.pdf", "no")):
        (tmp_path / name).write_bytes(text.encode())
    got = readers.text_folder(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.doc_id, r.text) for r in got] == [("a", "one\ntwo"), ("b", "three")]
    ingest.ingest(spark, str(tmp_path), str(tmp_path / "i" / "index"), str(tmp_path / "i" / "check")).awaitTermination()
    assert sorted(r.chunk_id for r in readers.index(spark, str(tmp_path / "i" / "index")).collect()) == ["a::0", "b::0"]


def test_collection_last_row_wins(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"1","title":"t","text":"old"}\n{"_id":"1","text":"new"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q","text":"x"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    data = readers.collection(spark, str(tmp_path))
    assert data.corpus.first().text == "new" and data.qrels.first().relevance == 1 and data.answers is None


def test_needles(spark):
    def put(hay, p):
        return spark.range(1).select(needles.inject(F.lit(hay), F.lit("N."), F.lit(float(p))).alias("x")).first().x

    assert put("One a. Two b. Three c.", 50) == "One a. Two b. N. Three c."
    assert put("One a. Two b.", 0).startswith("N. ") and put("One a. Two b.", 100).endswith(" N.")
    assert "N." in put("w " * 100, 50) and put("", 50) == "N."
    assert put("One a. Two b. Three c.", 10) == "N. One a. Two b. Three c." and put("aaa bbb ccc", 50) == "aaa bbb N. ccc"
    assert needles.grid(spark, list(LENGTHS), list(DEPTHS)).count() == 35
    needle = spark.createDataFrame([("The key is brass.", "What is the key?", "brass")], "text string, question string, answer string")
    hay = spark.createDataFrame([("word " * 20,)], "text string")
    got = answering.sweep(hay, needle, lengths=(50,), depths=(0, 50)).collect()
    assert len(got) == 2 and all(r.score == 1.0 for r in got)
    made = answering.contexts(hay, needle, (50, 2), (0, 50, 100)).collect()
    assert {len(r.context.split()) for r in made if r.context_length == 50} == {50} and {r.context for r in made if r.context_length == 2} == {"The key is brass."}


def test_answers(spark):
    c, q = docs(spark, "The key is brass. It is old.", "Nothing here."), asked(spark, "what is the key")
    got = answering.answer(c, q).first()
    assert got.answer == "The key is brass. It is old." and got.retrieved_chunks[0].doc_id == "d0"
    cited = answers.citations(spark.createDataFrame([("q0", "The key is brass. Fish swim.")], "query_id string, answer string"), c.select(F.lit("q0").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text")).collect()
    assert [(r.span_no, r.source_chunk_id) for r in cited] == [(0, "d0")]
    rows = spark.createDataFrame([("q", "brass key", "brass", ["a brass key", "no"])], "question_id string, prediction string, reference string, contexts array<string>")
    assert answers.evaluate(rows).first().asDict() == {"answer_correctness": 1.0, "context_precision": 0.5, "faithfulness": 1.0}
    assert [r.doc_id for r in overlap.top_k(c, q, 4).collect()] == ["d0"]


def test_passages_of_equal_score_come_in_corpus_order(spark):
    corpus = readers.in_memory(spark, {d: "nothing here" if d != "z" else "a brass key" for d in ("z", "y", "a", "b")})
    got = answering.answer(corpus, asked(spark, "brass")).first()
    assert [c.doc_id for c in got.retrieved_chunks] == ["z", "y", "a", "b"]


def test_the_first_query_is_the_first_of_the_collection(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"1","text":"red"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"z","text":"red"}\n{"_id":"10","text":"x"}\n{"_id":"9","text":"y"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nz\t1\t1\n")
    assert {r.query_id for r in runner.first_results(readers.collection(spark, str(tmp_path))).collect()} == {"z"}


def test_in_memory_corpus_and_report(spark):
    corpus = readers.in_memory(spark, {"b": "two words", "a": "one"})
    assert [(r.doc_id, r.ord) for r in corpus.orderBy("ord").collect()] == [("b", 0), ("a", 1)]
    qrels = spark.createDataFrame([("q", "a", 1)], "query_id string, doc_id string, relevance int")
    assert stats.report(stats.corpus_stats(corpus, asked(spark, "x"), qrels)).splitlines()[:2] == ["n_docs: 2", "n_queries: 1"]


def test_lines_keep_their_order_over_files_and_splits(spark, tmp_path):
    for name, first in (("a", 0), ("b", 300)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(first, first + 300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = readers.in_file_order(spark.read.schema("n int").json(str(tmp_path / "*.jsonl"))).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r.n for r in rows] == list(range(600))


def test_reshape(spark):
    t = spark.createDataFrame([("a", 0.5, 0.0), ("b", 0.6, 0.2)], "retriever string, mrr double, other double")
    long = reshape.melt(t)
    got = {r.metric: r for r in reshape.delta(long, "a", "b").collect()}
    assert got["mrr"].delta_abs == 0.1 and got["mrr"].delta_pct == "20.0%" and got["other"].delta_pct is None
    assert reshape.headline(t).count() == 2
    assert reshape.present(t, "retriever", ["b", "x", "a"]) == ["b", "a"] and [r.retriever for r in reshape.head(t, 1, "mrr").collect()] == ["a"]
    cells = spark.createDataFrame([(0, 1000, 1.0), (0, 1000, 0.5), (0, 2000, None), (50, 1000, None), (100, 4000, float("nan")), (100, 1000, 0.25)], "depth int, size int, score double")
    assert [r.asDict() for r in reshape.pivot_mean(cells, "depth", "size", "score").collect()] == [{"depth": 0, "1000": 0.75}, {"depth": 100, "1000": 0.25}]
    assert reshape.pivot_mean(cells, "depth", "size", "score", [2000, 1000]).columns == ["depth", "1000"]
    with pytest.raises(LookupError):
        reshape.delta(long, "a", "x")
    assert writers.comparison(long.select("retriever", "metric", F.col("score").alias("value")), ["mrr", "other"]).count() == 2


def test_csv_files_are_for_few_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.csv_file(spark.range(5), str(tmp_path / "x.csv"), most_rows=4)
    with pytest.raises(ValueError):
        writers.csv_file(spark.range(1).select(), str(tmp_path / "x.csv"))


def test_overlap_functions_agree_with_the_retriever(spark):
    from tarnlight.functions.text import keyword_overlap, overlap_score

    c, q = docs(spark, "Red apple red pie", "blue Sky", "red sky"), asked(spark, "red sky Red", "")
    pairs = q.crossJoin(c.withColumnRenamed("text", "body")).select("query_id", "doc_id", keyword_overlap(F.col("text"), F.col("body")).alias("n"), overlap_score(F.col("text"), F.col("body")).alias("score"))
    want = {(r.query_id, r.doc_id): r.score for r in pairs.where("n > 0").collect()}
    assert {(r.query_id, r.doc_id): r.score for r in overlap.top_k(c, q, 9).collect()} == want == {("q0", "d0"): 0.333, ("q0", "d1"): 0.333, ("q0", "d2"): 0.667}


def test_sentence_encoders_ask_for_unit_vectors(monkeypatch):
    import sys
    import types

    asked_for = []

    class Net:
        def __init__(self, model):
            asked_for.append(model)

        def encode(self, texts, **options):
            asked_for.append(options["normalize_embeddings"])
            return [[1.0, 0.0] for _ in texts]

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Net))
    assert dense.sentence_encoder("m")(["a", "b"]).tolist() == [[1.0, 0.0], [1.0, 0.0]] and asked_for == ["m", True]
    with pytest.raises(ValueError):
        dense.sentence_encoder(None)
