"""Packing of pieces into sequences, against the library's ids and a plain packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plantfuse.llm import packing, word_ids

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def library(path, plain):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@pytest.mark.parametrize("plain", [True, False])
def test_ids_of_words_are_those_of_whole_texts(path, plain):
    encoder = word_ids.WordIds(open(path, encoding="utf-8").read(), plain)
    assert encoder.split is not None
    points = [chr(point) for point in range(word_ids.KNOWN_POINTS)]
    texts = [a + point + b for point in points for a in ("", "a", " ", "'") for b in ("", "s", "1")]
    rng = np.random.default_rng(7)
    texts += ["".join(rng.choice([*points, *" 's1"] * 2, 40)) for _ in range(500)]
    texts += ["", "  two  spaces \n\n x", "it's 'sx 12's", "日本語の文 and more", "éx", "İX"]
    texts += ["a <|endoftext|> b", "<|startoftext|>"]
    exact = library(path, plain)
    want = [exact.encode(text, add_special_tokens=False).ids for text in texts]
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want


def test_unknown_files_go_to_the_library():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.pre_tokenizer = None
    encoder = word_ids.WordIds(tokenizer.to_str())
    assert encoder.split is None
    assert np.frombuffer(encoder.encode(["ab cd"])[0], "<u4").tolist() == tokenizer.encode("ab cd").ids


@given(st.lists(st.integers(1, 24), max_size=60), st.sampled_from([12, 16, 24]))
@settings(max_examples=150, deadline=None)
def test_patterns_place_every_piece_once(lengths, capacity):
    lengths = [min(length, capacity) for length in lengths]
    counts = np.bincount(lengths, minlength=capacity + 1)
    chosen = packing.patterns(counts)
    taken = np.zeros(capacity + 1, np.int64)
    for pattern, times in chosen:
        assert sum(pattern) <= capacity and times > 0
        np.add.at(taken, list(pattern), times)
    assert taken.tolist() == counts.tolist()


def first_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = next((n for n, room in enumerate(rooms) if room >= length), None)
        if at is None:
            rooms.append(capacity - length)
        else:
            rooms[at] -= length
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_as_few_sequences_as_first_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(np.exp(rng.normal(5, 1, 3000)).astype(int) + 1, 1024)
    counts = np.bincount(lengths, minlength=1025)
    taken = sum(times for _, times in packing.patterns(counts))
    assert taken <= first_fit(lengths.tolist(), 1024)
    assert taken <= -(-lengths.sum() // 1024) + 2


def test_the_sum_index_knows_what_the_counts_allow():
    counts = np.zeros(33, np.int64)
    counts[[5, 9, 13]] = 1, 1, 1
    index = packing.SumIndex(counts)
    assert index.filled((5,), 22, 2, 13) == (5, 13, 9)
    # Twice 9 would make 18, but there is only one of it.
    assert index.filled((13,), 18, 2, 9) is None
    counts[9] = 2
    index = packing.SumIndex(counts)
    assert index.filled((13,), 18, 2, 9) == (13, 9, 9)
    assert index.filled((5,), 23, 3, 9) is None
    counts[5] = 2
    assert packing.SumIndex(counts).filled((5,), 23, 3, 9) == (5, 9, 9, 5)


def checked(rows, texts, capacity):
    """Every piece is in place, gapless from 0; returns the number of sequences."""
    ids = {}
    tokenizer = library(WORD_BPE, False)
    for doc_id, text in texts:
        ids[doc_id] = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        of_doc[row["id"]].append(row)
        of_sequence[row["sequence"]].append((row["offset"], row["length"]))
    assert sorted(of_doc) == sorted(ids)
    for doc_id, found in of_doc.items():
        found.sort(key=lambda row: row["piece"])
        assert [row["piece"] for row in found] == list(range(len(found)))
        for row in found:
            assert row["start"] == capacity * row["piece"]
            want = np.array(ids[doc_id][row["start"] : row["start"] + capacity], "<u4").tobytes()
            assert row["length"] == len(want) // 4 and zlib.crc32(row["ids"]) == zlib.crc32(want)
    for parts in of_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(of_sequence)


def test_pieces_are_packed_whole(spark):
    rng = np.random.default_rng(3)
    texts = [(n, " ".join(["word"] * int(rng.integers(0, 150)))) for n in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "long " * 5000), (1003, "日本語 " * 40)]
    texts += [(2000 + n, "same copy of a text") for n in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    made = packing.packed(packing.pieces(docs, WORD_BPE, 128), 128)
    assert made.columns == ["id", "piece", "start", "length", "ids", "sequence", "offset"]
    rows = made.collect()
    sequences = checked(rows, texts, 128)
    total = sum(row["length"] for row in rows)
    assert sequences <= 1.01 * total / 128 + 1


def test_empty_repeated_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(packing.pieces(empty, WORD_BPE, 64), 64).collect() == []
    rows = [(None, "a b", 1, 2), (None, "a b", 1, 2), (7, None, None, None), (7, None, 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, task int, sequence long")
    found = packing.packed(packing.pieces(docs, WORD_BPE, 64), 64).collect()
    assert sorted((row["id"] is None, row["length"]) for row in found) == [
        (False, 1),
        (False, 1),
        (True, 3),
        (True, 3),
    ]
    assert sorted(row["offset"] for row in found) == [0, 3, 6, 7]
    assert len({row["sequence"] for row in found}) == 1
