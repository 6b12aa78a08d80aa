import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import AWKWARD, awkward, empty

from gleaner.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'aestTHE09é日  ", max_size=40)))
def test_ids_are_those_of_the_library(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(data=st.binary(max_size=40), start=st.integers(0, 40), length=st.integers(0, 6), new=st.binary(max_size=5), more=st.binary(max_size=8))
def test_edits_and_appends_equal_a_fresh_encoding(codec, data, start, length, new, more):
    start = min(start, len(data))
    edited = bpe.Prefixes(codec.vocabulary, data).replace(start, min(start + length, len(data)), new).append(more)
    assert edited.data == data[:start] + new + data[start + length :] + more
    assert edited.ids() == bpe.Prefixes(codec.vocabulary, edited.data).ids()


def test_long_text_edit_falls_in_step(codec):
    data = b"the cat sat on the mat " * 200
    edited = bpe.Prefixes(codec.vocabulary, data).replace(300, 304, b"dogs")
    assert edited.ids() == bpe.Prefixes(codec.vocabulary, edited.data).ids()


def test_memory_is_bounded_and_keeps_words_that_recur(codec, reference):
    tool, asked = bpe.Codec(PATH, public_tokenizers.PATTERN, 100), []
    make = tool.known.make
    tool.known.make = lambda x: asked.append(x) or make(x)
    for i in range(30):
        text = " ".join(f"the q{i}x{k} again, z{i}{k}" for k in range(60))
        assert tool.encode(text) == reference.encode_ordinary(text)
        for recent in (tool.known, tool.pieces, tool.vocabulary.pairs):
            assert len(recent) <= 100 and len(recent.old) <= 100
    assert asked.count("again,") == 1


def test_awkward_rows(spark, codec, reference):
    frame = awkward(spark)
    got = sorted((tuple(r) for r in bpe.digests(frame, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for r in frame.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(empty(spark), PATH, public_tokenizers.PATTERN).collect() == []


def test_encode_then_decode(spark):
    frame = awkward(spark).where("doc_id is not null")
    ids = bpe.encode(frame, PATH, public_tokenizers.PATTERN, keep=("doc_id", "score"))
    back = bpe.decode(ids, PATH, keep=("doc_id",))
    want = {r["doc_id"]: (r["text"] or "").encode() for r in frame.collect()}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == want
    assert len(AWKWARD) < len(want)
