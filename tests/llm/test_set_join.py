"""Pairs of sets by prefixes, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from plantfuse.llm import set_join


def families(rng, count=60):
    """Sets that share common elements, in families about the least index."""
    common = rng.integers(0, 2**64, 40, dtype=np.uint64)
    sets = []
    for _ in range(count):
        base = rng.integers(0, 2**64, int(rng.integers(1, 80)), dtype=np.uint64)
        shared = common[rng.random(len(common)) < 0.7]
        for _ in range(4):
            own = rng.integers(0, 2**64, int(rng.integers(0, 12)), dtype=np.uint64)
            kept = base[rng.random(len(base)) < 0.95]
            sets.append(np.unique(np.concatenate([kept, own, shared])))
    return [one for one in sets if len(one)]


def index(a, b):
    shared = len(np.intersect1d(a, b))
    return shared / (len(a) + len(b) - shared)


def expected(sets, roots, least):
    return {
        (a, b)
        for b in range(len(sets))
        for a in range(b)
        if roots[a] != roots[b] and index(sets[a], sets[b]) >= least
    }


def counts_of(sets):
    return np.bincount(
        set_join.buckets(np.concatenate(sets)), minlength=set_join.BUCKETS
    )


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95, 1.0])
def test_all_pairs_that_reach_the_index(spark, least):
    rng = np.random.default_rng(int(100 * least))
    sets = families(rng)
    roots = [n // 2 * 2 if n % 8 < 2 else n for n in range(len(sets))]
    counts = counts_of(sets)
    rows = [
        (n, roots[n], len(one), bytearray(set_join.prefix(one, counts, least).tobytes()))
        for n, one in enumerate(sets)
    ]
    frame = spark.createDataFrame(rows, "node long, root long, size long, prefix binary")
    got = [(row.a, row.b) for row in set_join.pairs(frame.repartition(3), least).collect()]
    want = expected(sets, roots, least)
    assert len(got) == len(set(got)) and want <= set(got)
    assert all(a < b and roots[a] != roots[b] for a, b in got)
    assert len(want) > 10 or least > 0.9
    # Few that cannot reach it are looked at.
    assert len(got) < 4 * len(want) + 200


def test_runs_in_any_cut_of_batches_and_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    size = 2000
    element = np.sort(rng.choice([-5, -1, 0, 3, 9], size, p=[0.02, 0.7, 0.2, 0.07, 0.01]))
    columns = [
        element,
        np.arange(size),
        rng.integers(0, 4, size),
        rng.integers(90, 110, size),
        rng.integers(0, 15, size),
    ]
    names = ["element", "node", "root", "size", "place"]
    whole = pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    def met(cuts):
        parts = [whole.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, size])]
        batches = set_join._meetings(0.8)(iter(parts))
        return sorted(pair for batch in batches for pair in zip(*map(pa.Array.to_pylist, batch)))

    want = sorted(
        (a, b)
        for a in range(size)
        for b in range(a + 1, size)
        if element[a] == element[b]
        and columns[2][a] != columns[2][b]
        and max(columns[4][a] - columns[3][a], columns[4][b] - columns[3][b])
        + np.ceil(0.8 / 1.8 * (columns[3][a] + columns[3][b]) - 1e-6)
        <= 0
    )
    assert len(want) > 1000
    assert met([]) == want
    monkeypatch.setattr(set_join, "TOGETHER", 5000)
    for cuts in ([1, 1, 700], sorted(rng.integers(0, size, 40).tolist()), list(range(0, size, 3))):
        assert met(cuts) == want


def test_prefixes_put_rare_elements_first():
    hashes = np.unique(np.random.default_rng(3).integers(0, 2**64, 100, dtype=np.uint64))
    counts = np.ones(set_join.BUCKETS, np.int64)
    counts[set_join.buckets(hashes[:50])] = 7
    # 80 of 100 shared leave 21.
    assert set(set_join.prefix(hashes, counts, 0.8)) <= set(hashes[50:])
    assert len(set_join.prefix(hashes, counts, 0.8)) == 21
    assert len(set_join.prefix(hashes[:5], counts, 0.8)) == 2
    assert len(set_join.prefix(hashes[:1], counts, 0.8)) == 1
    assert len(set_join.prefix(hashes[:0], counts, 0.8)) == 0
