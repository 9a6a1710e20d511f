import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tarnlight.llm import bpe, pieces, queries, token_store

ODD = ["", "a", "  x", " x  y", "a\nb", "a\n\nb \n c", "é b c\u0085d　 e f", "don 't it's I'm  's, we've.", "<|endoftext|> a <|endoftext|>b", "x" * 100 + " y",
       None, "a\x1cb c\x1f d", "日本 語　の test", "🙂 🙂🙂 a", " ", " a", "a ", "\n", "\nq", "q\n", "  ", "  b", "tab\tx y", "w.x,y;z (a) b)c d!? e...f", "\x00 a\x00", "a " * 3000]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(queries.byte_bpe())


@pytest.mark.parametrize("most", [600_000, 3])
def test_piece_tables_against_the_library(library, most):
    definition = bpe.read_definition(queries.byte_bpe())
    own, table, _ = bpe._loaded(definition)
    _, _, other = token_store._table(definition)
    table.most = other.most = most
    plain = [t for t in ODD if not (t and "<|" in t)]
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    for _ in range(2):  # new pieces, then known ones
        got, ends = own.encode(table, pa.array(ODD, pa.string()))
        assert [got[a:z].tolist() for a, z in zip(ends, ends[1:])] == [ids(t) for t in ODD]
        got, ends = other.encode(pa.array(plain, pa.string()))
        assert [got[a:z].tolist() for a, z in zip(ends, ends[1:])] == [ids(t) for t in plain]
    table.most = other.most = 600_000


def test_pieces_are_the_text_and_cut_no_white_space():
    raw, at = pieces.utf8(pa.array(ODD, pa.string()))
    begin = pieces.cuts(raw, at, pieces.white(raw))
    assert begin[0] == 0 and begin[-1] == len(raw) and set(at.tolist()) <= set(begin.tolist())
    text = "".join(t or "" for t in ODD)
    cut = [raw[a:z].tobytes().decode() for a, z in zip(begin, begin[1:])]  # every piece is UTF-8
    assert "".join(cut) == text


def test_equal_keys_of_different_pieces_are_told_apart(library):
    table = pieces.PieceTable(lambda texts: [np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for t in texts], np.zeros(60_000, np.int64))
    number = np.array([table._one(b"ab")])
    table.words[number] = [[7, 0, 0, 0]]  # another piece of the key looked for
    table.key[number] = 5
    table._insert(np.array([5], np.uint64), number)
    assert table._find(np.array([5], np.uint64), np.array([[8, 0, 0, 0]], np.uint64)).tolist() == [-1]
    assert table._find(np.array([5], np.uint64), np.array([[7, 0, 0, 0]], np.uint64)).tolist() == number.tolist()


def test_round_trip_and_store_over_a_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in text.items()}
    rows = bpe.round_trip(docs, queries.byte_bpe()).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    path, start = token_store.scratch_path(spark), 0
    token_store.write_ids(docs, queries.byte_bpe(), path)
    got = {r.doc_id: r for r in token_store.digests(spark, path).collect()}
    back = {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()}
    for i in sorted(text):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 0], "<u4").tobytes()))
        assert back[i] == [*ids[i], 0]
        start += len(ids[i]) + 1


def test_other_tokenizers_go_through_the_library_whole(spark, tmp_path, library):
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 1, "b": 2, "?": 3}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "t.json"))
    docs = spark.createDataFrame([(2, "b, a"), (1, "a c"), (3, None)], "doc_id long, text string")
    path = token_store.scratch_path(spark)
    token_store.write_ids(docs, str(tmp_path / "t.json"), path)
    assert {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()} == {1: [1, 3, 0], 2: [2, 3, 1, 0], 3: [0]}
    with pytest.raises(ValueError):
        bpe.ByteBPE(other.to_str())


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, 1, "n"), (1, "a b", 2, "m"), (1, "a b", 3, "l")], "doc_id long, text string, start int, ids string")
    assert bpe.round_trip(docs.limit(0), queries.byte_bpe()).count() == 0
    assert sorted(r.n_tokens for r in bpe.round_trip(docs, queries.byte_bpe()).collect()) == [0, 2, 2]
    for rows, want in ((docs, [1, 3, 3]), (docs.limit(0), [])):
        path = token_store.scratch_path(spark)
        token_store.write_ids(rows, queries.byte_bpe(), path)
        assert sorted(r.n_tokens for r in token_store.digests(spark, path).collect()) == want
    both = bpe.decode(bpe.encode(docs, queries.byte_bpe()), queries.byte_bpe()).collect()
    assert sorted(r.text for r in both) == ["", "a b", "a b"]


def test_ids_unknown_to_the_vocabulary_decode_to_nothing():
    own = bpe._loaded(bpe.read_definition(public_tokenizers.path("byte_bpe_50k.json")))[0]
    first = int(own.first[ord("a")])
    assert own.decode([first, 10**6, -1, first]) == "aa" and own.decode([int(own.first[0xFF])]) == "�"
