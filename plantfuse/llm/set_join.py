"""All pairs of sets whose Jaccard index may reach a bound, by prefixes of their elements.

Every set puts its elements into one order, the rare ones first. Two sets that
share at least ``n`` elements share one among the first ``size - n + 1`` of each:
the first that they share has ``n - 1`` shared ones behind it in both. An index of
``least`` needs ``least / (1 + least)`` of both sizes together as shared elements,
and so never fewer than ``least`` times a set's own size. A set therefore goes to
its first ``size - ceil(least * size) + 1`` elements, each with its place, and two
sets that meet at an element are a pair only if as many elements as the index
needs still follow in both. No pair is lost: it is found at the first element
that both have.

Any order gives the same pairs, if it is the same for all sets. Rare elements
first keeps what many sets share, as a passage or a license, out of the prefixes.
How rare one is comes from ``BUCKETS`` counters of hashed elements; elements of
one count are in order of their hashes.

Sets that are known to belong together have the same root and are no pair. At an
element the sets of its commonest root meet only those of others, so that work
there is in proportion to the sets if nearly all are of one root. What is left to
grow faster are sets of many roots that share nearly as much as the index needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantfuse.llm.shared import sized_slices, text_sizes

#: Counters of elements, by the first bits of their hashes.
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS

#: Bytes of prefixes that become rows together, pairs of one element that are looked
#: at together, and pairs of an output batch.
TOGETHER = 1 << 20

#: What a product of floating numbers may be too large by.
SLACK = 1e-6

POSTING = "element long, node long, root long, size long, place long"


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The counter of each 64-bit hash."""
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def counted(numbers: DataFrame) -> np.ndarray:
    """All counters, from (bucket, count) of the tasks: a fixed number of rows."""
    counts = np.zeros(BUCKETS, np.int64)
    for row in numbers.groupBy("bucket").agg(F.sum("count").alias("count")).collect():
        counts[row["bucket"]] = row["count"]
    return counts


def prefix(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first elements of a set, from its different hashes in order."""
    size = len(hashes)
    shared = max(1, int(np.ceil(least * size - SLACK)))
    order = np.argsort(counts[buckets(hashes)], kind="stable")
    return hashes[order[: max(0, size - shared + 1)]]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each element of a prefix, from (node, root, size, prefix)."""
    for batch in sized_slices(batches, lambda b: text_sizes(b, 3), TOGETHER):
        nodes, roots, sizes = (batch.column(n).to_numpy() for n in range(3))
        parts = [np.frombuffer(part, "<i8") for part in batch.column(3).to_pylist()]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths) - lengths
        columns = [
            np.concatenate([np.zeros(0, np.int64), *parts]),
            *(np.repeat(column, lengths) for column in (nodes, roots, sizes)),
            np.arange(lengths.sum()) - np.repeat(starts, lengths),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column) for column in columns],
            names=["element", "node", "root", "size", "place"],
        )


def meeting(
    roots: np.ndarray, sizes: np.ndarray, places: np.ndarray, least: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one element that may reach the index, each once, in bounded parts."""
    share = least / (1 + least)
    values, of_row, times = np.unique(roots, return_inverse=True, return_counts=True)
    other = of_row != np.argmax(times)
    outside = np.flatnonzero(other)
    step = max(1, TOGETHER // len(roots))
    everyone = np.arange(len(roots))
    for start in range(0, len(outside), step):
        left = outside[start : start + step, None]
        shared = np.ceil(share * (sizes[left] + sizes) - SLACK)
        near = (places[left] + shared <= sizes[left]) & (places + shared <= sizes)
        # Two rows of rarer roots are both in turn the left one.
        near &= (roots[left] != roots) & (~other | (left < everyone))
        at, right = np.nonzero(near)
        yield left[at, 0], right


def _meetings(least: float):
    """(a, b): pairs of nodes, from postings in order of elements."""
    share = least / (1 + least)

    def of_parts(parts: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = pa.Table.from_batches(parts)
        element, node, root, size, place = (column.to_numpy() for column in whole.columns)
        if not len(element):
            return
        starts = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
        stops = np.append(starts[1:], len(element))
        # Some set must be the lesser of a pair, and some root another one.
        lesser = np.logical_or.reduceat(
            place + np.ceil(2 * share * size - SLACK) <= size, starts
        )
        roots = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        for at in np.flatnonzero(lesser & roots).tolist():
            run = slice(starts[at], stops[at])
            for left, right in meeting(root[run], size[run], place[run], least):
                yield node[run][left], node[run][right]

    def of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            elements = batch.column(0).to_numpy()
            # The last element's rows may go on in the next batch.
            begin = int(np.searchsorted(elements, elements[-1]))
            if begin or elements[-1] != last:
                if held or begin:
                    yield from of_parts([*held, batch.slice(0, begin)])
                held = []
            held.append(batch.slice(begin))
            last = elements[-1]
        if held:
            yield from of_parts(held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights, count = [], [], 0
        for left, right in of_runs(batches):
            lefts.append(np.minimum(left, right))
            rights.append(np.maximum(left, right))
            count += len(left)
            if count >= TOGETHER:
                yield _pairs(lefts, rights)
                lefts, rights, count = [], [], 0
        if count:
            yield _pairs(lefts, rights)

    return met


def _pairs(lefts: list[np.ndarray], rights: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(side)) for side in (lefts, rights)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def pairs(prefixes: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of nodes of different roots that may reach the index.

    ``prefixes`` has (node, root, size, prefix), longs but for the last, which has
    the elements of ``prefix`` as little-endian bytes. No pair has its nodes twice,
    and none that reaches the index is left out.
    """
    return (
        prefixes.mapInArrow(_postings, POSTING)
        .repartition("element")
        .sortWithinPartitions("element")
        .mapInArrow(_meetings(least), "a long, b long")
        .distinct()
    )
