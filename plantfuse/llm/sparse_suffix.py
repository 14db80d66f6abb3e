"""Passages that documents share word for word, from sparse suffix arrays.

Words are split at ASCII white space, A-Z lower-cased. A passage repeats if two
documents of different ids hold the same ``passage`` words in a row.

1. Of each window of ``passage`` words, one of the first ``spread`` positions is
   chosen by content alone: the one whose ``GRAM`` words hash least, the leftmost
   of equals. Only suffixes at chosen positions are retained, about two for
   every ``spread`` words. Equal windows choose alike, so what repeats has a
   retained suffix in either document, at the same place of the passage.
2. A retained suffix is sorted by its first passage - spread + 1 words, all of
   which lie within each window that chose it, as their hash. It carries its
   extensions: for each such window the hash of the words from the window's
   start, left of the suffix, to its end on the right.
3. Among neighbours in that order equal extensions of different documents are
   repeats. (Sorting by the right side only and comparing one neighbour would
   miss a partner with more words in common on the left.) Overlapping windows
   join to the whole passage, however long.

Suffixes that a task meets with equal extensions in several documents are
settled at once: only the one of the least id is sorted with all others. A
passage in a third of all documents thus moves once a task. Windows count as
equal if hashes of 64 bits (sort key) and 32 bits (window) agree.

NULL, empty and short texts share nothing. Repeats within one document, and rows
of the same id, are no repeats across documents. A NULL id is one id, before all
others. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import slices

PASSAGE, SPREAD, GRAM = 50, 16, 3
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Words whose hashes a task remembers before it forgets all of them.
REMEMBERED = 300_000
#: Retained suffixes of a task that are settled together.
SETTLED = 100_000


def mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ numbers >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return numbers ^ numbers >> np.uint64(29)


class Spans:
    """Hashes of runs of words, from prefix sums modulo 2**64."""

    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    steps = (BASE, pow(BASE, -1, 1 << 64))

    def __init__(self, words: np.ndarray):
        while len(self.powers[0]) <= len(words):
            size = len(self.powers[0])
            type(self).powers = [
                np.concatenate([known, known * np.uint64(pow(step, size, 1 << 64))])
                for known, step in zip(self.powers, self.steps)
            ]
        terms = words * self.powers[0][: len(words)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        return mixed((self.sums[starts + size] - self.sums[starts]) * self.powers[1][starts])


def retained(words: np.ndarray, passage: int, spread: int):
    """(place, first, count, key, checks) of a text's retained suffixes.

    ``place`` is the suffix's word, ``first`` and ``count`` its windows' starts,
    ``checks`` all windows' hashes one after the other.
    """
    windows = len(words) - passage + 1
    if windows < 1:
        return None
    spans = Spans(words)
    every = np.arange(windows)
    order = spans.of(np.arange(windows + spread - 1), GRAM)
    chosen = every + np.lib.stride_tricks.sliding_window_view(order, spread).argmin(1)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    place = chosen[first]
    return (
        place,
        first,
        np.diff(first, append=windows),
        spans.of(place, passage - spread + 1),
        (spans.of(every, passage) >> np.uint64(32)).astype(np.uint32),
    )


SUFFIX = [("key", pa.int64()), ("place", pa.int32()), ("first", pa.int32()),
          ("count", pa.int32()), ("settled", pa.bool_()), ("checks", pa.list_(pa.int32()))]


def _hash_words(texts: list[bytes | None], known: dict[bytes, int]) -> list[np.ndarray]:
    if len(known) > REMEMBERED:
        known.clear()
    hashed = []
    for text in texts:
        words = (text or b"").lower().split()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashed.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return hashed


def _suffixes(passage: int, spread: int):
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[tuple] = []
        ids: list[pa.Array] = []
        size = 0
        for batch in slices(batches):
            rows, found = [], []
            for row, words in enumerate(_hash_words(batch.column(1).to_pylist(), known)):
                of_text = retained(words, passage, spread)
                if of_text:
                    found.append(of_text)
                    rows.append(np.full(len(of_text[0]), row))
            if not found:
                continue
            ids.append(batch.column(0).take(pa.array(np.concatenate(rows))))
            held += found
            size += len(ids[-1])
            if size >= SETTLED:
                yield _settled(pa.concat_arrays(ids), held)
                held, ids, size = [], [], 0
        if held:
            yield _settled(pa.concat_arrays(ids), held)

    return of_task


def _ranks(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, NULL first."""
    return pc.rank(ids, tiebreaker="dense", null_placement="at_start").to_numpy()


def _settled(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    """The suffixes, where many documents have the same all but one without checks."""
    place, first, count, key, checks = (np.concatenate(part) for part in zip(*found))
    ends = np.cumsum(count)
    spans = Spans(checks.astype(np.uint64))
    sums = (spans.sums[ends] - spans.sums[ends - count]) * spans.powers[1][ends - count]
    whole = mixed(mixed(key + (place - first).astype(np.uint64)) + sums + count.astype(np.uint64))
    rank = _ranks(ids)
    order = np.lexsort((rank, whole))
    new = np.diff(whole[order], prepend=~whole[order[:1]]) != 0
    group = np.cumsum(new) - 1
    least = rank[order][new][group]
    settled = np.zeros(len(order), bool)
    settled[order] = rank[order] != least
    # All documents of a group but the least are repeats of it; it is still to be sorted.
    several = np.zeros(len(order), bool)
    several[order] = (np.bincount(group, rank[order] != least) > 0)[group]
    stays = ~settled
    offsets = np.concatenate([[0], np.cumsum(np.where(stays, count, 0))]).astype(np.int32)
    kept = checks[np.repeat(stays, count)].view(np.int32)
    # What is settled needs no sorting: any key that spreads it will do.
    key = np.where(settled, mixed(whole + np.arange(len(whole)).astype(np.uint64)), key)
    columns = [key.view(np.int64), place, first, count, several, pa.ListArray.from_arrays(offsets, kept)]
    arrays = [pa.array(column, kind) for column, (_, kind) in zip(columns, SUFFIX)]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *(name for name, _ in SUFFIX)])


def _compared(passage: int):
    """Repeats, as runs of words, from suffixes in the order of their keys."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            # The last key's suffixes may go on in the next batch.
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield _repeats([*waiting, batch.slice(0, whole)], passage)
                waiting = []
            waiting.append(batch.slice(whole))
        if waiting:
            yield _repeats(waiting, passage)

    return of_task


def _repeats(batches: list[pa.RecordBatch], passage: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    column = {name: rows.column(name).combine_chunks() for name in rows.column_names}
    key, place, first, count, settled = (
        column[name].to_numpy(zero_copy_only=False) for name in ("key", "place", "first", "count", "settled")
    )
    sizes = pc.list_value_length(column["checks"]).to_numpy()
    checks = column["checks"].flatten().to_numpy().view(np.uint32)
    rank = _ranks(column["id"])

    # One entry for each window that is still to be compared.
    row = np.repeat(np.arange(len(key)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place_in = (place - first)[row] - at
    shared = np.diff(key, prepend=key[:1]) == 0
    shared[:1] = False
    alone = ~(shared | np.append(shared[1:], False)) & ~settled
    worth = ~alone[row]
    row, at, place_in, checks = row[worth], at[worth], place_in[worth], checks[worth]
    same = mixed(key.view(np.uint64)[row] + place_in.astype(np.uint64)) ^ checks
    order = np.lexsort((rank[row], same))
    new = np.diff(same[order], prepend=~same[order[:1]]) != 0
    group = np.cumsum(new) - 1
    least = rank[row][order][new][group] if len(order) else group
    later = np.zeros(len(row), bool)
    later[order] = rank[row][order] != least
    many = np.zeros(len(row), bool)
    many[order] = (np.bincount(group, rank[row][order] != least) > 0)[group] if len(order) else False
    many |= settled[row]

    def runs(marked: np.ndarray, kind: bool):
        """Neighbouring marked windows of a suffix as one run of words."""
        line = row[marked] * (1 << 20) + at[marked]
        start = np.flatnonzero(np.diff(line, prepend=-2) != 1)
        stop = np.append(start[1:], len(line)) - 1 if len(start) else start
        which = row[marked][start]
        begin = first[which] + at[marked][start]
        return which, begin, first[which] + at[marked][stop] + passage, np.full(len(which), kind)

    # Without checks: settled in its task, all its windows are held by a lesser id.
    bare = np.flatnonzero(sizes == 0)
    all_bare = [
        (bare, first[bare], first[bare] + count[bare] - 1 + passage, np.full(len(bare), kind))
        for kind in (False, True)
    ]
    parts = [runs(many, False), runs(later, True), *all_bare]
    which, begin, end, kind = (np.concatenate(part) for part in zip(*parts))
    return pa.RecordBatch.from_arrays(
        [
            column["id"].take(pa.array(which)),
            pa.array(begin, pa.int64()),
            pa.array(end, pa.int64()),
            pa.array(kind, pa.bool_()),
        ],
        names=["id", "first", "end", "later"],
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole passages from overlapping runs, in order of ids and first words."""
    ids, spans = [], []
    owner, open_ = None, None

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), *(pa.array([span[n] for span in spans], pa.int64()) for n in range(3))],
            names=["id", "first", "end", "n_later"],
        )
        ids.clear()
        spans.clear()
        return batch

    kind = pa.null()
    for batch in slices(batches, 4096):
        kind = batch.schema.field(0).type
        for key, first, end, later in zip(*(column.to_pylist() for column in batch.columns)):
            if open_ is None or key != owner or first > open_[1]:
                if open_ is not None:
                    ids.append(owner)
                    spans.append(open_[:3])
                # first, end, words of later runs, where these reach
                owner, open_ = key, [first, end, 0, first]
            open_[1] = max(open_[1], end)
            if later:
                open_[2] += max(0, end - max(first, open_[3]))
                open_[3] = max(open_[3], end)
        if len(ids) >= 4096:
            yield flush()
    if open_ is not None:
        ids.append(owner)
        spans.append(open_[:3])
    if ids:
        yield flush()


def repeated_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    passage: int = PASSAGE,
    spread: int = SPREAD,
) -> DataFrame:
    """(id, first, end, n_later): maximal runs of words that repeat across documents.

    ``first`` and ``end`` count the document's words, end exclusive; every word
    of the run is in a window of ``passage`` words that another id holds too.
    ``n_later`` counts those in windows that a lesser id holds: removing them
    leaves each passage in the document of least id.
    """
    id_type = docs.schema[id_column].dataType
    field = T.StructField
    number = T.IntegerType()
    kinds = [T.LongType(), number, number, number, T.BooleanType(), T.ArrayType(number)]
    suffixes = T.StructType(
        [field("id", id_type), *(field(name, kind) for (name, _), kind in zip(SUFFIX, kinds))]
    )
    runs = T.StructType(
        [
            field("id", id_type),
            field("first", T.LongType()),
            field("end", T.LongType()),
            field("later", T.BooleanType()),
        ]
    )
    spans = T.StructType([*runs.fields[:3], field("n_later", T.LongType())])
    return (
        docs.select(id_column, F.col(text_column).cast("binary"))
        .mapInArrow(_suffixes(passage, spread), suffixes)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_compared(passage), runs)
        .distinct()
        .repartition("id")
        .sortWithinPartitions("id", "first", "end", "later")
        .mapInArrow(_joined, spans)
    )
