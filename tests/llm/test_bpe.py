import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plantfuse.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
EXACT = tiktoken.Encoding(
    "exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
TOKENIZER = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)


@given(st.lists(st.text(max_size=80), max_size=5))
@settings(deadline=None, max_examples=150)
def test_ids_are_those_of_the_public_library(texts):
    ids = TOKENIZER.encode(texts)
    assert [of.tolist() for of in ids] == [EXACT.encode_ordinary(text) for text in texts]
    assert [TOKENIZER.decode(of) for of in ids] == [text.encode() for text in texts]


@pytest.mark.parametrize("text", ["ab" * 20_000, "x" * 9_999, " " * 5_000, "你好" * 300])
def test_long_pieces(text):
    assert TOKENIZER.encode([text])[0].tolist() == EXACT.encode_ordinary(text)


@given(st.binary(min_size=2, max_size=bpe.SHORT))
@settings(deadline=None, max_examples=100)
def test_one_tree_and_many_merge_alike(piece):
    width = 1 << (len(piece) - 1).bit_length()
    packed = TOKENIZER.forest.merge([piece, piece[:2]], width)
    alone = bpe.Tokenizer.merge(TOKENIZER, piece)
    if piece not in RANKS:
        assert list(memoryview(packed[0]).cast("i")) == alone


def test_tree_finds_the_leftmost_least_pair():
    tree = bpe.PairTree([5, 3, None, 3, 9])
    assert tree.leftmost() == 1
    tree.put(1, None)
    assert tree.leftmost() == 3
    for at in range(5):
        tree.put(at, None)
    assert tree.leftmost() is None


def test_rows_with_gaps_copies_and_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "one two", "c"), (3, "one two", None)],
        "doc_id long, text string, ids string",
    )
    rows = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((row.id or 0, row.ids, bytes(row.decoded)) for row in rows) == [
        (0, EXACT.encode_ordinary("one two"), b"one two"),
        (1, [], b""),
        (2, [], b""),
        (3, EXACT.encode_ordinary("one two"), b"one two"),
    ]
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_over_the_documents(spark, sf_dir):
    from plantfuse.llm.queries import op7_byte_bpe

    texts = {
        row.doc_id: row.text or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    }
    for row in op7_byte_bpe(spark, sf_dir).collect():
        ids = EXACT.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
