"""Encoding against the public library, over a whole table and over hard strings."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import bpe
from cohortloom.session import table

PATH = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder(PATH).ranks, special_tokens={})


def test_table(spark, sf, theirs):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(table(spark, sf, "documents")).collect()}
    assert got == {k: theirs.encode_ordinary(v) if v else [] for k, v in docs.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's  \n\t\x1c\x1f\x85  　​é中の1²½٣🔧́<|endoftext|>\x00"), max_size=60))
def test_strings(text):
    enc = bpe.encoder(PATH)
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    assert enc.encode(text) == own.encode_ordinary(text)


def test_cases(spark, theirs):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (3, " ", "x"), (4, long, "x"), (5, "<|endoftext|>", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_documents(df).collect())
    assert got == [(1, []), (2, []), *[(3, theirs.encode_ordinary(" "))] * 2, (4, theirs.encode_ordinary(long)), (5, theirs.encode_ordinary("<|endoftext|>"))]
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, ["doc_id"]).collect()} == {k: len(v) for k, v in got}
    assert bpe.encode_documents(df.limit(0)).collect() == []
