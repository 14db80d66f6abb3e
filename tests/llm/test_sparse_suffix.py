import random

import numpy as np
import pytest

from plantfuse.llm import sparse_suffix
from plantfuse.llm.queries import op5_sparse_suffix


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, passage):
    """All (id, first, end, n_later) from every window of every text."""
    rank = lambda value: (value is not None, value or 0)
    held = {}
    split = [(doc_id, lower(text).split()) for doc_id, text in rows]
    for doc_id, words in split:
        for at in range(len(words) - passage + 1):
            held.setdefault(tuple(words[at : at + passage]), set()).add(doc_id)
    marks = {}
    for doc_id, words in split:
        some, later = marks.setdefault(doc_id, (set(), set()))
        for at in range(len(words) - passage + 1):
            ids = held[tuple(words[at : at + passage])]
            if len(ids) > 1:
                some.update(range(at, at + passage))
                if min(map(rank, ids)) < rank(doc_id):
                    later.update(range(at, at + passage))
    out = []
    for doc_id, (some, later) in marks.items():
        # Touching runs are one run.
        for first in sorted(some):
            if first - 1 not in some:
                end = first
                while end in some:
                    end += 1
                out.append((doc_id, first, end, len(later & set(range(first, end)))))
    return sorted(out, key=str)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, key int")
    return sorted(map(tuple, sparse_suffix.repeated_passages(frame.repartition(6), **options).collect()), key=str)


def documents(rng, count, passage):
    """Texts of few words, some of which share passages around the threshold."""
    shared = [rng.choices("abcdefgh", k=passage + rng.randrange(-3, 9)) for _ in range(6)]
    rows = []
    for doc_id in range(count):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choices("abcdefghijklmnop", k=rng.randrange(20))
            words += rng.choice(shared)[rng.randrange(3) :]
        rows.append((doc_id, rng.choice([" ", "\n", " \t"]).join(words).upper()))
    return rows


@pytest.mark.parametrize(("passage", "spread", "settled"), [(12, 4, 100_000), (12, 4, 1), (9, 1, 50), (20, 16, 10)])
def test_against_brute_force(spark, monkeypatch, passage, spread, settled):
    monkeypatch.setattr(sparse_suffix, "SETTLED", settled)
    rng = random.Random(passage * spread)
    rows = documents(rng, 60, passage)
    rows += [(100, None), (101, ""), (None, rows[5][1]), (None, rows[5][1]), (7, rows[9][1])]
    rows += [(102, "a " * 80), (103, "a " * 70), (104, "b c " * 60), (105, "b c " * 3)]
    assert found(spark, rows, passage=passage, spread=spread) == brute(rows, passage)


def test_equal_windows_choose_alike():
    rng = np.random.default_rng(1)
    inside = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    chosen = []
    for before, after in ((0, 0), (5, 70), (200, 3)):
        around = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (before, after)]
        place, first, count, key, checks = sparse_suffix.retained(
            np.concatenate([around[0], inside, around[1]]), 50, 16
        )
        assert count.sum() == len(checks) == before + after + 60 - 50 + 1
        windows = {
            s - before: (p - s, k, c)
            for p, f, n, k in zip(place, first, count, key)
            for s, c in zip(range(f, f + n), checks[f : f + n])
        }
        chosen.append([windows[at] for at in range(11)])
    assert chosen[0] == chosen[1] == chosen[2]


def test_a_passage_of_all_documents_and_a_very_long_text(spark):
    rng = random.Random(2)
    passage = [f"p{n}" for n in range(60)]
    rows = [
        (n, " ".join([f"{n}x{i}" for i in range(rng.randrange(30))] + passage + [f"y{n}"])) for n in range(300)
    ]
    rows.append((-1, " ".join(f"w{n}" for n in range(150_000)) + " " + " ".join(passage[:50])))
    got = found(spark, rows)
    assert len(got) == 301 and got == brute(rows, 50)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "short"), (2, "short")]) == []


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, op5_sparse_suffix(spark, sf_dir).collect()), key=str)
    assert got and got == brute(rows, 50)
