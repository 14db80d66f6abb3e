"""Packing of token sequences by exact complements, then by best fit.

Pieces are packed by length alone, so the whole choice is made over a histogram
with one count for each length up to the capacity, whatever the number of
pieces. From the longest length down, a length's gap is looked up among the sums
of one, two and three lengths that are left. A combination that fills the gap
exactly is taken as often as the counts allow, which uses up one of its lengths.
What no combination completes is packed best fit, longest first: a piece goes
where it leaves the least room, and opens a sequence only if it fits in none.

The choice is a list of patterns, each with the number of times it is taken.
Every piece knows its number among the pieces of its length: its task counts
them as they are made, and a running sum over tasks gives the numbers before. A
pattern owns a range of numbers of each of its lengths, so a piece finds its
sequence by a search in the list. The pieces themselves are not sorted and no
group of them is gathered, however many have one length.

A NULL or empty text is the end token alone. Rows are independent and may repeat
an id. Pieces of full length are a sequence each. An empty table has no pieces.
Columns other than the id and the text play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import slices, written
from plantfuse.llm.word_ids import ID, word_ids

#: Above the number of pieces of any one length.
MOST = 1 << 48

Pattern = tuple[int, ...]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Each text's ids and an end id, cut at every ``capacity`` ids.

    Per piece: id, piece (from 0), start, length, ids (packed, unsigned 32-bit
    little-endian), and its number ``nth`` among the pieces of its length in
    task ``task``. The tokenizer's file, of the size of a vocabulary, is read
    on the driver and sent to the executors once. Strings of special tokens in
    a text are what the file says they are.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text("utf-8"))
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("task", T.IntegerType()),
            T.StructField("nth", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(file.value, False), np.array([end_id], ID).tobytes()
        task, step = TaskContext.get().partitionId(), capacity * ID.itemsize
        made: Counter[int] = Counter()
        for batch in slices(batches):
            rows, starts, lengths, parts, nth = [], [], [], [], []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for row, ids in enumerate(encoder.encode(texts)):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    length = len(part) // ID.itemsize
                    rows.append(row)
                    starts.append(at // ID.itemsize)
                    lengths.append(length)
                    parts.append(part)
                    nth.append(made[length])
                    made[length] += 1
            first = np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array((first // capacity).astype(np.int32)),
                    pa.array(first),
                    pa.array(lengths, pa.int64()),
                    pa.array(parts, pa.binary()),
                    pa.array(np.full(len(rows), task, np.int32)),
                    pa.array(nth, pa.int64()),
                ],
                names=schema.names,
            )

    return docs.select(id_column, text_column).mapInArrow(cut, schema)


class SumIndex:
    """Which of the lengths that are left add up to a sum.

    Single lengths are looked up by their count and pairs in a list by sum.
    Three lengths are one length and a pair of the rest: all triples would be
    some hundred times as many as the pairs. Whether a sum has any pair is seen
    at once from two sets of bits, the lengths left and the same in reverse.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.capacity = len(left) - 1
        lengths = np.flatnonzero(left)
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        keep = (a >= b) & (a + b <= self.capacity)
        a, b = a[keep], b[keep]
        order = np.argsort(a + b, kind="stable")
        self.a, self.b = a[order], b[order]
        self.starts = np.searchsorted((a + b)[order], np.arange(self.capacity + 2))
        self.bits = sum(1 << n for n in lengths.tolist())
        self.reversed = sum(1 << self.capacity - n for n in lengths.tolist())

    def times(self, pattern: Pattern) -> int:
        """How often the counts that are left allow a pattern."""
        return min(int(self.left[n]) // times for n, times in Counter(pattern).items())

    def take(self, pattern: Pattern) -> int:
        """Uses up a pattern as often as it can be taken."""
        times = self.times(pattern)
        for n in pattern:
            self.left[n] -= times
        for n in set(pattern):
            if not self.left[n]:
                self.bits &= ~(1 << n)
                self.reversed &= ~(1 << self.capacity - n)
        return times

    def filled(self, begun: Pattern, gap: int, parts: int, most: int) -> Pattern | None:
        """A pattern with so many more lengths, none above ``most``, that fill the gap."""
        if parts == 1:
            pattern = (*begun, gap)
            return pattern if gap <= most and self.times(pattern) else None
        if parts == 2:
            if not self.bits & self.reversed >> self.capacity - gap:
                return None
            at = slice(self.starts[gap], self.starts[gap + 1])
            a, b = self.a[at], self.b[at]
            # Lengths of which there are many first: they are the last to run out.
            many = np.where(a <= most, np.minimum(self.left[a], self.left[b]), 0)
            while len(many) and many[best := int(many.argmax())]:
                pattern = (*begun, int(a[best]), int(b[best]))
                if self.times(pattern):
                    return pattern
                many[best] = 0
            return None
        for third in range(min(most, gap - 2), 0, -1):
            if self.left[third]:
                pattern = self.filled((*begun, third), gap - third, 2, third)
                if pattern:
                    return pattern
        return None


def exact_fills(left: np.ndarray, least: int = 1) -> Iterator[tuple[Pattern, int]]:
    """Patterns of up to four lengths that fill the capacity, as often as each is taken.

    Few long pieces in a sequence come first, so that short ones, which fill
    any gap, last. The longest of a pattern is ``least`` or more. ``left`` has
    the count of each length from 0 to the capacity; it is left with what no
    pattern completes.
    """
    capacity = len(left) - 1
    index = SumIndex(left)
    if left[capacity]:
        yield (capacity,), index.take((capacity,))
    for parts in (1, 2, 3):
        for length in range(capacity - 1, least - 1, -1):
            while left[length]:
                pattern = index.filled((length,), capacity - length, parts, length)
                if pattern is None:
                    break
                yield pattern, index.take(pattern)


def best_fit(left: np.ndarray) -> Iterator[tuple[Pattern, int]]:
    """Packs what is left longest first, each where it leaves the least room."""
    capacity = len(left) - 1
    # Sequences begun, by the room they have: pattern and how many there are.
    begun: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                pattern, there = begun[room].pop()
                rooms[room] = bool(begun[room])
                used = min(count, there)
                if there > used:
                    begun[room].append((pattern, there - used))
                    rooms[room] = True
                more = 1
            else:
                more = min(capacity // length, count)
                room, pattern, used = capacity, (), count // more
            pattern += (length,) * more
            begun[room - more * length].append((pattern, used))
            rooms[room - more * length] = True
            count -= used * more
        left[length] = 0
    for of_room in begun:
        yield from of_room


def patterns(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """The patterns of a histogram of lengths, index 0 to the capacity.

    Short pieces may be needed to fill up long ones that have no exact
    complement. So the choice is made twice, once with exact patterns of short
    pieces alone and once without, and the one of fewer sequences is taken.
    """
    tried = []
    for least in (1, len(counts) // 2 + 1):
        left = np.array(counts, np.int64)
        left[0] = 0
        tried.append([*exact_fills(left, least), *best_fit(left)])
    return min(tried, key=lambda chosen: sum(times for _, times in chosen))


def places(chosen: list[tuple[Pattern, int]]) -> tuple[np.ndarray, ...]:
    """Where numbered pieces go: (key, sequence, offset) in order of keys.

    A key is a length times ``MOST`` plus the first number of a range of pieces.
    """
    given: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in chosen:
        offset = 0
        for length in pattern:
            rows.append((length * MOST + given[length], sequence, offset))
            given[length] += times
            offset += length
        sequence += times
    rows.sort()
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with their ``sequence`` and ``offset``.

    ``pieces`` has ``length``, ``task`` and ``nth`` as above and any other
    columns. They are written once, since numbers must not change between the
    count and the placing. The driver holds one count for each length and the
    patterns, of which there are at most a few for each length.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    made = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("made"))
    made = written(made, "pieces-made")
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in made.groupBy("length").agg(F.sum("made")).collect():
        counts[length] = count
    found = spark.sparkContext.broadcast(places(patterns(counts)))

    earlier = Window.partitionBy("length").orderBy("task")
    before = made.select(
        F.col("task").alias("of_task"),
        F.col("length").alias("of_length"),
        (F.sum("made").over(earlier) - F.col("made")).alias("before"),
    )

    @F.pandas_udf("sequence long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = found.value
        wanted = length.to_numpy(np.int64) * MOST + number.to_numpy(np.int64)
        at = np.searchsorted(keys, wanted, "right") - 1
        return pd.DataFrame({"sequence": sequences[at] + wanted - keys[at], "offset": offsets[at]})

    same = (pieces["task"] == F.col("of_task")) & (pieces["length"] == F.col("of_length"))
    kept = [pieces[f"`{name}`"] for name in pieces.columns if name not in ("task", "nth")]
    return (
        pieces.join(before, same)
        .select(*kept, place("length", F.col("before") + F.col("nth")).alias("place"))
        .select(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("task", "nth")], "place.*")
    )
