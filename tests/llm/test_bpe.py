"""Operator 13 against the library, whole texts at a time."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegrain.llm import bpe
from tests.llm.conftest import EDGE

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(texts):
    column = pa.array(texts, pa.string())
    data, offs = bpe.texts_of(column)
    starts, before = bpe.pre_tokens(data, offs)
    ends = [*starts[1:].tolist(), len(data)][: len(starts)]
    whole = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends, strict=True)]
    return [whole[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]


TRICKY = ["it's", " 's", "''s", "x's's", "'ll 're've'mm'dog 'LL", "\n's", "a  'd", "  a", "a   ", " \n x", " a  b", "１２ ½ x²", "don't''t", "' s", "'", "'s", "", "áb", "漢字 テスト", "\U0001f600!? #1", "\x1c\x85 a", "'r'v'l", "'relate 'veto"]


def test_pre_tokens_are_those_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert cut(TRICKY) == [pattern.findall(t) for t in TRICKY]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'srtdlmve aL1½ \n\t é漢-_.\U0001f600", max_size=40), max_size=5))
def test_pre_tokens_of_any_text(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert cut(texts) == [pattern.findall(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**28 - 1), max_size=50))
def test_packed_numbers_come_back(numbers):
    packed, size = bpe.pack_numbers(np.array(numbers, np.int64))
    assert bpe.unpack_numbers(packed).tolist() == numbers and len(packed) == size.sum()


def told(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, list(r.ids), bytes(r.decoded)) for r in df.select("doc_id", "ids", "decoded").collect()), key=str)


@pytest.mark.parametrize("chunk_bytes", [1, 1 << 12, bpe.CHUNK_BYTES])
def test_equals_the_library(spark, docs_of, library, chunk_bytes):
    rows = [*EDGE, *enumerate(TRICKY, 100), (300, "<|endoftext|> plain"), (301, "a" * 30_000), (302, " " * 5000), (303, "word " * 20_000 + "rareሴ")]
    want = sorted(((i if i is not None else -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert told(bpe.decode(bpe.encode(docs_of(rows), chunk_bytes=chunk_bytes))) == want


def test_other_columns_stay_and_tables_may_be_empty(spark, docs_of):
    extra = [(c, "mine") for c in ("ids", "chunk", "codes", "words", "own", "local", "word", "decoded", "n")]
    made = bpe.encode(docs_of([(1, "Hello there"), (2, None)], extra))
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "chunk", "codes", "words", "own", "local", "word", "decoded", "n", "ids"]
    rows = {r.doc_id: r for r in made.collect()}
    assert rows[1].word == "mine" and rows[1].own == "mine" and rows[2].ids == []
    back = bpe.decode(made)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: b"Hello there", 2: b""} and back.columns.count("decoded") == 1
    assert bpe.encode(docs_of([])).count() == 0
    only = spark.createDataFrame([("a b",)], "body string")
    assert [r.ids for r in bpe.encode(only, "body").collect()] == [r.ids for r in bpe.encode(docs_of([(1, "a b")])).collect()]


def test_the_query_holds_every_document(spark, library):
    from tests.llm.conftest import SF

    got = {r.doc_id: tuple(r) for r in bpe.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
