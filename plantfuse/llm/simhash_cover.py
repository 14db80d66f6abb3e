"""SimHash fingerprints and the documents whose fingerprints nearly agree.

Fingerprints of 64 bits link at up to two differing bits. Candidates meet at
anchors: the words of a covering code, the direct product of nine Hamming
[7,4] codes and one free bit. Every word of seven bits is within one bit of
exactly one code word, so the code covers all fingerprints with radius 9.

Two fingerprints that differ in up to two bits have a midpoint, at most one bit
from either. The midpoint's nearest anchor is the anchor of one of the 65 words
within one bit of each, and so within the covering radius plus the threshold of
both. A fingerprint therefore goes to the anchors of these 65 words, which are
1 + 3 u + 1 different ones if u of its nine groups are no code words (of all
anchors within radius plus threshold, the only ones that a link can need), and
all links are found at some anchor.

Only different fingerprints are dealt to anchors: copies share one, however many
they are. At an anchor the fingerprints are compared pair by pair while they are
few; above ``PAIRS`` each looks up the 2,080 words within two bits of it
instead, so work stays in proportion to the fingerprints. What leaves an anchor
is not its pairs but each fingerprint's least link, and one link per step of a
spanning forest, which keeps every connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.graph import components
from plantfuse.llm.shared import slices, written

# Fixed values of the fingerprint.
BITS = 64
SEED = 42
SHINGLE = 3
THRESHOLD = 2

GROUPS, GROUP_BITS = 9, 7
#: Fingerprints at an anchor up to which all pairs are compared.
PAIRS = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def _nearest_code_word() -> np.ndarray:
    """For each word of seven bits, the code word within one bit of it.

    The syndrome of a word, the exclusive or of the places of its set bits
    counted from one, names the bit to change.
    """
    words = np.arange(1 << GROUP_BITS)
    syndrome = np.zeros_like(words)
    for place in range(GROUP_BITS):
        syndrome ^= np.where(words >> place & 1, place + 1, 0)
    return np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome, 1) - 1), words)


NEAREST = _nearest_code_word().astype(np.uint64)


def anchor_of(words: np.ndarray) -> np.ndarray:
    """The nearest anchor of each word; the free bit is its own."""
    free = np.uint64(1 << (GROUPS * GROUP_BITS))
    anchors = words & free
    for group in range(GROUPS):
        shift = np.uint64(group * GROUP_BITS)
        anchors |= NEAREST[(words >> shift & np.uint64(127)).astype(np.intp)] << shift
    return anchors


def anchors_near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors of all words within one bit of each word."""
    flips = np.concatenate([[0], 1 << np.arange(BITS, dtype=np.uint64)]).astype(np.uint64)
    near = np.sort(anchor_of(words[:, None] ^ flips), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(new)[0], near[new]


def fingerprint_of(text: bytes | None) -> int:
    """Bits set in over half of the hashes of a text's shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    shingles = max(1, len(words) - SHINGLE + 1)
    ends = (starts + sizes - 1)[len(words) - shingles :].tolist()
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hashed(line[start:end], SEED) for start, end in zip(starts.tolist(), ends)),
        np.dtype("<u8"),
        shingles,
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, shingles, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > shingles, bitorder="little")
    return int(bits.view(np.dtype("<u8"))[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, word): every row's id and the signed 64 bits of its fingerprint."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("word", T.LongType()),
        ]
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = np.array(
                [fingerprint_of(text) for text in batch.column(1).to_pylist()], np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.view(np.int64))], names=["id", "word"]
            )

    texts = docs.select(F.col(id_column), F.col(text_column).cast("binary"))
    return texts.mapInArrow(hashed, schema)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        words = batch.column(0).to_numpy().view(np.uint64)
        row, anchor = anchors_near(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(words[row].view(np.int64))],
            names=["anchor", "word"],
        )


def links_at(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all words of one anchor within the threshold.

    Of every word's links to lesser words one is kept for each lesser group
    that it joins, so that there are fewer links than words.
    """
    count = len(words)
    words = np.sort(words)
    if count <= PAIRS:
        apart = np.bitwise_count(words[:, None] ^ words) <= THRESHOLD
        left, right = np.nonzero(np.triu(apart, 1))
    else:
        one = 1 << np.arange(BITS, dtype=np.uint64)
        two = (one[:, None] ^ one)[np.triu_indices(BITS, 1)]
        lefts, rights = [], []
        for flip in np.concatenate([one, two]):
            other = words ^ flip
            at = np.minimum(np.searchsorted(words, other), count - 1)
            found = np.flatnonzero((words[at] == other) & (words < other))
            lefts.append(found)
            rights.append(at[found])
        left, right = np.concatenate(lefts), np.concatenate(rights)
    root = list(range(count))

    def top(at: int) -> int:
        while root[at] != at:
            root[at] = at = root[root[at]]
        return at

    kept = []
    for number, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(number)
    return words[left[kept]], words[right[kept]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links at each anchor, from rows in order of anchors."""

    def linked(anchors: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(anchors, prepend=anchors[:1] - 1))
        stops = np.append(starts[1:], len(anchors))
        shared = stops - starts > 1
        found = [links_at(words[a:b]) for a, b in zip(starts[shared], stops[shared])]
        empty = np.zeros(0, np.uint64)
        left, right = (np.concatenate([empty, *side]) for side in zip((empty, empty), *found))
        return pa.RecordBatch.from_arrays(
            [pa.array(left.view(np.int64)), pa.array(right.view(np.int64))],
            names=["word", "other"],
        )

    anchors, words = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        anchors = np.concatenate([anchors, batch.column(0).to_numpy()])
        words = np.concatenate([words, batch.column(1).to_numpy().view(np.uint64)])
        # The last anchor's rows may go on in the next batch.
        whole = np.searchsorted(anchors, anchors[-1:])[0] if len(anchors) else 0
        if whole:
            yield linked(anchors[:whole], words[:whole])
            anchors, words = anchors[whole:], words[whole:]
    if len(anchors):
        yield linked(anchors, words)


def links(words: DataFrame) -> DataFrame:
    """(word, other): links that connect different words within the threshold."""
    dealt = words.mapInArrow(_dealt, "anchor long, word long")
    return (
        dealt.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_compared, "word long, other long")
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, word, component): every row's fingerprint and its component's least id.

    NULL texts and texts without words have fingerprint zero and link like any
    other. Rows with the same id are linked by that id only if their
    fingerprints are. A NULL id is returned as it is and is never the least
    unless its component has no other.
    """
    marked = written(fingerprints(docs, id_column, text_column), "fingerprints")
    words = marked.groupBy("word").agg(F.min("id").alias("least"))
    words = written(words, "words")
    roots = components(links(words.select("word")))
    in_root = words.join(roots.withColumnRenamed("node", "word"), "word", "left").select(
        "word", "least", F.coalesce("root", "word").alias("root")
    )
    in_root = written(in_root, "word-roots")
    least = in_root.groupBy("root").agg(F.min("least").alias("component")).checkpoint()
    named = in_root.join(least, "root").select("word", "component")
    return marked.join(named, "word").select("id", "word", "component")
