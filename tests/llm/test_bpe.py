import hashlib
import sys

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe

sys.path.insert(0, "/opt/tokenizers")
import public_tokenizers as public  # noqa: E402


@pytest.fixture(scope="module")
def theirs():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks())}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(bpe.load_ranks())


def test_the_whole_table_is_encoded_as_by_the_public_encoder(spark, small, theirs):
    docs = small("documents")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, bpe.vocabulary(spark)).collect()}
    for r in docs.collect():
        assert list(got[r["doc_id"]]["token_ids"]) == theirs.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["decoded_md5"] == hashlib.md5(r["text"].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), max_size=6))
def test_any_text_is_encoded_alike_and_comes_back(theirs, ours, texts):
    ids = ours.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [theirs.encode_ordinary(t) for t in texts]
    assert ours.decode(ids).to_pylist() == texts


def test_long_words_go_by_the_same_ranks(theirs, ours):
    texts = ["ab" * 3000, "x" * 65, "supercalifragilistic" * 9, "<|endoftext|>", "a" * 64]
    assert ours.encode(pa.array(texts)).to_pylist() == [theirs.encode_ordinary(t) for t in texts]


def test_unknown_ids_and_broken_bytes_are_replaced(ours):
    assert ours.decode(pa.array([[50256, None, -1], [ours.byte[0xFF]], None, []], pa.list_(pa.int32()))).to_pylist() == ["���", "�", None, ""]


def test_odd_rows(spark, odd, odd_rows, nothing):
    ranks = bpe.vocabulary(spark)
    back = bpe.decode(bpe.encode(odd, ranks), ranks).select("doc_id", "text").collect()
    assert sorted(map(repr, ((r[0], r[1]) for r in back))) == sorted(repr((r[0], r[1])) for r in odd_rows)
    assert bpe.round_trip(nothing, ranks).count() == 0
