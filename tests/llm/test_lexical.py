"""Ranked search, against a brute force over all documents and terms."""

import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest

from plantfuse.llm import lexical

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return re.findall(TERM, (text or "").translate(str.maketrans(upper, lower)))


def brute_force(docs, items, top=10):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    df = Counter(term for _, counts in counted for term in counts)
    documents = sum(bool(counts) for _, counts in counted)
    length = sum(counts.total() for _, counts in counted)
    of_items = defaultdict(set)
    for item, text in items:
        of_items[item].update(terms(text))
    found = []
    for item, wanted in of_items.items():
        scored = []
        for doc_id, counts in counted:
            score = 0
            for term in wanted & set(counts):
                weight = floor(1000 * log((2 * documents + 2) / (2 * df[term] + 1)))
                m = 10 + 90 * counts.total() * documents // length
                score += weight * (10**9 * counts[term] // (1000 * counts[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, there, doc_id) in enumerate(sorted(scored)[:top], 1):
            found.append((item, rank, doc_id if there else None, -score))
    return sorted(found, key=str)


def searched(spark, docs, items, parts=3, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    of_items = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.ranked(frame, of_items, **more)
    assert found.columns == ["item", "rank", "id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def some_texts(rng, count, words):
    zipf = np.minimum(rng.zipf(1.3, (count, words)), 400)
    return [" ".join(f"w{word}" for word in row[: rng.integers(0, words)]) for row in zipf]


@pytest.mark.parametrize("sizes", [(128, 4096), (2, 16)])
def test_ranks_are_those_of_a_brute_force(spark, monkeypatch, sizes):
    bundle, bucket = sizes
    rng = np.random.default_rng(bundle)
    docs = list(enumerate(some_texts(rng, 400, 30)))
    # A third of all documents are copies: their scores tie.
    docs += [(1000 + n, "w1 w2 w3 hot copy w90") for n in range(200)]
    docs += [(None, None), (None, "w7 w7 w7"), (2000, ""), (2001, "w5 " * 3000)]
    items = list(enumerate(some_texts(rng, 7, 12))) + [(50, "hot copy"), (51, "of none"), (52, None)]
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    assert searched(spark, docs, items) == brute_force(docs, items)


def test_blocks_and_unfiltered_terms_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = list(enumerate(some_texts(rng, 120, 20)))
    items = list(enumerate(some_texts(rng, 9, 10)))
    want = brute_force(docs, items, 3)
    monkeypatch.setattr(lexical, "BLOCK", 20)
    monkeypatch.setattr(lexical, "LOOKED_FOR", 5)
    assert searched(spark, docs, items, top=3) == want


def test_terms():
    assert lexical.terms_of("Don't STOP-4 Éaİ x_y [z]") == [
        "don", "t", "stop", "4", "Éaİ", "x", "y", "z"
    ]
    assert lexical.terms_of(None) == []


def test_one_item_in_several_rows_and_empty_tables(spark):
    docs = [(1, "red green"), (2, "green blue"), (3, "blue"), (4, "grey")]
    items = [(None, "red"), (None, "green"), (None, "red"), (8, "blue blue")]
    assert searched(spark, docs, items) == brute_force(docs, items)
    assert searched(spark, [], items) == []
    assert searched(spark, docs, []) == []
    assert searched(spark, docs, [(1, "nothing of this"), (2, "...")]) == []


def test_clashing_columns_and_ids_of_another_type(spark):
    docs = spark.createDataFrame(
        [("b", "one two", 1, 2), ("a", "one two", 3, 4), ("c", "three", 5, 6)],
        "doc_id string, text string, row int, item int",
    )
    items = spark.createDataFrame([("q", "two", 9)], "item_id string, text string, score int")
    rows = lexical.ranked(docs, items).collect()
    assert sorted((row.rank, row.id) for row in rows) == [(1, "a"), (2, "b")]


def test_accumulators_that_cannot_win_are_not_carried(spark):
    rng = np.random.default_rng(11)
    docs = list(enumerate(some_texts(rng, 600, 40)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(0, "w1 w2 w60 w70")], "item_id long, text string")
    terms_of_items = lexical.item_terms(items, "item_id", "text")
    counts = lexical.term_counts(frame, terms_of_items, "doc_id", "text")
    documents = sum(bool(text) for _, text in docs)
    length = sum(len(terms(text)) for _, text in docs)
    known = lexical._known_terms(counts, terms_of_items, documents, length)
    entries = [(0, row.term, row.df, row.most) for row in known.collect()]
    kept = lexical._search(counts, entries, documents, length, 3).count()
    with_common_term = sum("w1" in terms(text) for _, text in docs)
    assert 3 <= kept < with_common_term / 4
