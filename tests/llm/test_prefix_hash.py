import hashlib
import random
from collections import Counter
from itertools import takewhile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantfuse.llm import prefix_hash
from plantfuse.llm.prefix_hash import Hashed, PrefixHash, code_points
from plantfuse.llm.queries import op3_prefix_hash

TEXT = st.text(alphabet="ab\0é€𝄞", max_size=60)


def common(a, b):
    return sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(a, b)))


@given(TEXT, TEXT, st.data())
@settings(deadline=None)
def test_spans_and_extensions(one, other, data):
    left, right = PrefixHash(code_points(one)), PrefixHash(code_points(other))
    i = data.draw(st.integers(0, len(one)))
    j = data.draw(st.integers(0, len(other)))
    assert left.extension(i, right, j) == common(one[i:], other[j:])
    k = data.draw(st.integers(0, min(len(one) - i, len(other) - j)))
    assert (left.span(i, i + k) == right.span(j, j + k)) == (one[i : i + k] == other[j : j + k])
    spans = left.spans(3)
    words = [one[n : n + 3] for n in range(max(0, len(one) - 2))] or ([one] if one else [])
    assert [int(h) for h in spans] == [dict(zip(words, spans.tolist()))[word] for word in words]
    assert len(set(spans.tolist())) == len(set(words))


@given(TEXT, TEXT)
@settings(deadline=None)
def test_an_edited_text_has_the_prefix_arrays_of_its_own(one, other):
    kept = len(one) // 2
    edited = PrefixHash(code_points(one)).edited(code_points(one[:kept] + other), kept)
    for a, b in zip(edited.sums, PrefixHash(code_points(one[:kept] + other)).sums):
        assert a.tolist() == b.tolist()


def test_sums_against_their_definition():
    text = "".join(map(chr, random.Random(1).choices(range(0xD7FF), k=5_000)))
    for base, sums in zip(prefix_hash.BASES, PrefixHash(code_points(text)).sums):
        total = 0
        for at, char in enumerate(text):
            total = (total + (ord(char) + 1) * pow(base, at, prefix_hash.PRIME)) % prefix_hash.PRIME
            assert at % 997 or total == int(sums[at + 1])


@pytest.mark.parametrize("size", [0, 1, 5, 20, 50, 3_000])
def test_likeness_estimates_the_jaccard_index_of_spans(size):
    rng = random.Random(size)
    one = "".join(rng.choices("abcd ", k=size))
    other = one[: size * 3 // 4] + "".join(rng.choices("abcd ", k=size - size * 3 // 4))
    span = min(prefix_hash.span_of(size), size)
    a, b = (Counter(t[n : n + span] for n in range(size - span + 1)) for t in (one, other))
    exact = (a & b).total() / (a | b).total() if one else 1.0
    found = prefix_hash.likeness(Hashed(0, one).least, Hashed(0, other).least)
    assert abs(found - exact) < (1e-9 if size <= 20 else 0.3)
    assert prefix_hash.likeness(Hashed(0, one).least, Hashed(0, one).least) == 1.0


def brute(rows):
    rows = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or ""))
    out = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    common(text, edited), common(text, after), text, edited, after))
    return out


def check(rows, wanted):
    made = {}
    for row, want in zip(rows, wanted, strict=True):
        assert (row.id, row.n_chars, row.edited_sha256) == want[:3]
        assert (row.same_start_edited, row.same_start_next) == want[3:5]
        text, edited, after = (Hashed(0, part) for part in want[5:])
        assert row.fingerprint == prefix_hash.fingerprint_text(text.prefix, text.least)
        assert row.edited_fingerprint == prefix_hash.fingerprint_text(edited.prefix, edited.least)
        assert row.near_edited == prefix_hash.likeness(text.least, edited.least)
        assert row.near_next == prefix_hash.likeness(text.least, after.least)
        assert made.setdefault(want[5], row.fingerprint) == row.fingerprint


@pytest.mark.parametrize("range_bytes", [64, 16 << 20])
def test_against_brute_force(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(prefix_hash, "RANGE_BYTES", range_bytes)
    rng = random.Random(2)
    rows = [(None, "of no id"), (None, None), (-5, ""), (2**62, "é" * 5_000), (2**62 + 1, "x")]
    rows += [(7, "twice"), (7, "twice"), (7, None), (7, "Twice again")]
    rows += [(n * n, "".join(rng.choices("abé \n", k=rng.randrange(90)))) for n in range(9, 90)]
    frame = spark.createDataFrame([(*row, "p") for row in rows], "doc_id long, text string, part string")
    found = prefix_hash.compared_with_next(frame.repartition(5)).collect()
    wanted = brute(rows)
    order = {(w[0], w[1], w[2]): n for n, w in enumerate(wanted)}
    found.sort(key=lambda row: order[row.id, row.n_chars, row.edited_sha256])
    wanted.sort(key=lambda w: order[w[:3]])
    check(found, wanted)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "alone in its table")]])
def test_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(prefix_hash.compared_with_next(frame).collect(), brute(rows))


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = sorted(op3_prefix_hash(spark, sf_dir).withColumnRenamed("doc_id", "id").collect())
    check(found, brute(rows))
    assert np.quantile([row.near_edited for row in found], 0.05) > 0.3
    assert np.quantile([row.near_next for row in found], 0.5) < 0.1


@pytest.mark.parametrize("switch", [1, 2, 16, 32, 64])
def test_likeness_across_a_switch_of_the_span_length(switch):
    rng = random.Random(switch)
    for size, more in [(switch - 1, 1), (switch - 1, 3), (switch, 1), (switch - 1, 21)]:
        one = "".join(rng.choices("abcdefgh ", k=size))
        other = one + "".join(rng.choices("abcdefgh ", k=more))
        span = min(prefix_hash.span_of(size), size)
        a, b = (Counter(t[n : n + span] for n in range(len(t) - span + 1)) for t in (one, other))
        exact = (a & b).total() / (a | b).total() if size else 0.0
        found = [prefix_hash.likeness(Hashed(0, x).least, Hashed(0, y).least) for x, y in [(one, other), (other, one)]]
        assert found[0] == found[1] and abs(found[0] - exact) < 0.3


@pytest.mark.parametrize("size", [17, 20, 33, 41, 64, 84])
def test_three_quarters_of_a_text_stay_like_it_across_a_switch(size):
    doc = Hashed(1, "".join(random.Random(size).choices("abcdefgh ", k=size)))
    row = prefix_hash.compared(doc, Hashed(2, None))
    assert row[5] > 0.4 and row[6] == 0.0


def test_error_of_the_likeness_of_edited_texts():
    rng = np.random.default_rng(8)
    errors = []
    for _ in range(150):
        size = int(rng.integers(100, 8000))
        codes = rng.integers(97, 123, size + size // 4)
        one = "".join(map(chr, codes[:size]))
        kept = size - size // int(rng.integers(3, 9))
        other = one[:kept] + "".join(map(chr, codes[size : 2 * size - kept]))
        spans = [Counter(text[n : n + 16] for n in range(len(text) - 15)) for text in (one, other)]
        exact = (spans[0] & spans[1]).total() / (spans[0] | spans[1]).total()
        errors.append(prefix_hash.likeness(Hashed(0, one).least, Hashed(0, other).least) - exact)
    assert np.std(errors) < 0.03 and abs(np.mean(errors)) < 0.01
