import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plantfuse.llm import simhash_cover as cover
from plantfuse.llm.graph import components
from plantfuse.llm.queries import op2_simhash_cover


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def brute_components(words):
    """The least index reachable over words within two bits, by all pairs."""
    least = list(range(len(words)))
    changed = True
    while changed:
        changed = False
        for a in range(len(words)):
            for b in range(a):
                if bin(words[a] ^ words[b]).count("1") <= 2 and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


@given(st.text(alphabet="aAbÉé \t\x0b\x1c\xa0\n", max_size=200))
@settings(deadline=None)
def test_fingerprints(text):
    assert cover.fingerprint_of(text.encode()) == brute_fingerprint(text)


def test_fingerprint_of_a_very_long_text():
    text = " ".join(random.Random(1).choices("abcdefgh", k=3 * cover.CHUNK))
    assert cover.fingerprint_of(text.encode()) == brute_fingerprint(text)


def test_anchors_cover_with_radius_nine_and_meet_every_link():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    apart = np.bitwise_count(words ^ cover.anchor_of(words))
    assert apart.max() <= 9
    assert (cover.anchor_of(cover.anchor_of(words)) == cover.anchor_of(words)).all()
    flips = rng.integers(0, 64, (2, 300)).astype(np.uint64)
    others = words ^ np.uint64(1) << flips[0] ^ np.uint64(1) << flips[1]
    for word, other in zip(words, others):
        near = cover.anchors_near(np.array([word]))[1]
        assert np.isin(cover.anchors_near(np.array([other]))[1], near).any()
        assert np.bitwise_count(near ^ word).max() <= 9 + 2
        groups = sum(cover.NEAREST[int(word) >> 7 * g & 127] != int(word) >> 7 * g & 127 for g in range(9))
        assert len(near) == 1 + 3 * groups + 1


@pytest.mark.parametrize("pairs", [0, 512])
def test_links_at_an_anchor_connect_what_all_pairs_connect(monkeypatch, pairs):
    monkeypatch.setattr(cover, "PAIRS", pairs)
    rng = random.Random(7)
    words = sorted({sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(150)})
    left, right = cover.links_at(np.array(words, np.uint64))
    assert len(left) < len(words)
    joined = {word: word for word in words}
    for a, b in zip(left.tolist(), right.tolist()):
        assert bin(a ^ b).count("1") <= 2
        old, new = max(joined[a], joined[b]), min(joined[a], joined[b])
        joined = {word: new if top == old else top for word, top in joined.items()}
    wanted = brute_components(words)
    assert [joined[word] for word in words] == [words[at] for at in wanted]


def found(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, word int")
    return {row.id: (row.word, row.component) for row in cover.near_duplicates(frame).collect()}


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=40) for _ in range(12)]
    texts = [None, "", " \t", "one", "ONE", "one two", "x " * 5_000]
    for _ in range(120):
        words = list(rng.choice(base))
        words[rng.randrange(40)] = rng.choice("abc")
        texts.append(" ".join(words))
    texts += texts[:9]
    rows = [(900 - n, text, n) for n, text in enumerate(texts)]
    rows.sort()
    words = [brute_fingerprint(text) for _, text, _ in rows]
    least = brute_components(words)
    got = found(spark, rows)
    assert len(set(least)) > 5
    for (doc_id, _, _), word, at in zip(rows, words, least):
        assert got[doc_id] == (word - (word >> 63 << 64), rows[at][0])


def test_a_chain_of_links_and_many_copies(spark, monkeypatch):
    rows = [(n, "same text of a hot group", 0) for n in range(400)]
    got = found(spark, rows)
    assert {component for _, component in got.values()} == {0}
    chain = [((1 << n) - 1 << 1, (1 << n) - 1 << 1 | 1 << n + 1) for n in range(60)]
    links = spark.createDataFrame([(b, a) for a, b in chain] + [(5, 5)], "a long, b long")
    nodes = {node: root for node, root in components(links).collect()}
    assert len(nodes) == 61 and set(nodes.values()) == {0}


def test_no_rows_and_missing_ids(spark):
    assert found(spark, []) == {}
    frame = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    rows = cover.near_duplicates(frame).collect()
    assert sorted((row.id or -1, row.component) for row in rows) == [(-1, 4), (4, 4), (4, 4)]


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted(
        (row.doc_id, row.text) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    )
    words = [brute_fingerprint(text) for _, text in docs]
    least = brute_components(words)
    assert sorted(tuple(row) for row in op2_simhash_cover(spark, sf_dir).collect()) == [
        (doc_id, f"{word:016x}", docs[at][0]) for (doc_id, _), word, at in zip(docs, words, least)
    ]
