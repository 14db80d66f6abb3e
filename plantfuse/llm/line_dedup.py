"""Lines that many documents share, found with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys
of at least ``min_chars`` code points that at least ``min_docs`` documents hold
lose all their lines, except in the document of the largest id that holds them.

1. Every task hashes the keys of its documents, each key once a document, into
   two filters: bits met once and bits met twice. Tasks send their filters in
   blocks of 65,536 bits, each as the sorted 16-bit places of its set bits, so
   that what moves is two bytes a key and not a filter a task. A block's parts
   are added up in the shuffle: a bit that two parts have once is met twice.
2. The twice-seen filter, whose size is bounded by ``max_filter_bytes``, goes to
   all executors. Keys whose bit is unset are in one document and never move. A
   fuller filter only lets more keys pass; the next step is exact either way.
3. The suspected keys are written as (key, id) without repeats. Counting them
   gives the keys to drop and the document that keeps each.
4. The keys that a document loses are gathered by id and its lines filtered.

A key in a third of all documents is one row per document in step 3, spread by
(key, id), summed within tasks before its count, and split by Spark when joined.

NULL and empty texts are one empty line. Rows with the same id count as one
document and each is treated on its own text. A NULL id is an id, less than all
others. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import slices, written

#: Fixed value: white space that is stripped from a line.
SPACE = b" \t\n\x0b\x0c\r"

BLOCK_BITS = 1 << 16


def key_of(line: bytes) -> bytes:
    """UTF-8 in and out; bytes.lower() changes A-Z only."""
    return line.strip(SPACE).lower()


def long_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    """The keys of a text that have at least so many code points."""
    keys = {line.strip(SPACE).lower() for line in (text or b"").split(b"\n")}
    return {
        key
        for key in keys
        if len(key) >= min_chars and (key.isascii() or len(key.decode(errors="replace")) >= min_chars)
    }


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """The filter's bit of each key; bits is a power of two."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return hashed & np.uint64(bits - 1)


def _partial_filters(min_chars: int, bits: int):
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in slices(batches):
            keys: list[bytes] = []
            for text in batch.column(0).to_pylist():
                keys += long_keys(text, min_chars)
            seen.append(places(keys, bits))
        bit, times = np.unique(np.concatenate(seen), return_counts=True) if seen else ([], [])
        if not len(bit):
            return
        block = bit // np.uint64(BLOCK_BITS)
        starts = np.flatnonzero(np.diff(block, prepend=block[0] + np.uint64(1)))
        for start, stop in zip(starts, [*starts[1:], len(bit)]):
            low = (bit[start:stop] % np.uint64(BLOCK_BITS)).astype(np.uint16)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([int(block[start])], pa.int64()),
                    "once": pa.array([low.tobytes()], pa.binary()),
                    "twice": pa.array([low[times[start:stop] > 1].tobytes()], pa.binary()),
                }
            )

    return of_task


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-seen bits of each block, from rows in order of blocks."""
    block, once, twice = None, None, None
    for batch in slices(batches):
        for row in batch.to_pylist():
            if row["block"] != block:
                if block is not None:
                    yield _block_row(block, twice)
                block = row["block"]
                once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
            here = np.frombuffer(row["once"], np.uint16)
            twice[here[once[here]]] = True
            twice[np.frombuffer(row["twice"], np.uint16)] = True
            once[here] = True
    if block is not None:
        yield _block_row(block, twice)


def _block_row(block: int, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([block], pa.int64()),
            "bits": pa.array([np.packbits(twice).tobytes()], pa.binary()),
        }
    )


def twice_seen(texts: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """Blocks of the filter of keys that more than one document may hold."""
    partial = texts.mapInArrow(
        _partial_filters(min_chars, bits), "block long, once binary, twice binary"
    )
    return (
        partial.repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_added_up, "block long, bits binary")
    )


def filter_bits(n_bytes: int, max_filter_bytes: int) -> int:
    """Bits enough for the keys of so many bytes of text, as a power of two."""
    wanted = max(BLOCK_BITS, n_bytes // 8)
    return min(1 << (wanted - 1).bit_length(), 1 << ((8 * max_filter_bytes).bit_length() - 1))


def shared_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    max_filter_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, keys): the keys whose lines each document loses, where it loses any."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(n_bytes, max_filter_bytes)

    whole = np.zeros(bits // 8, np.uint8)
    for row in twice_seen(texts.select("text"), min_chars, bits).collect():
        start = row.block * BLOCK_BITS // 8
        whole[start : start + BLOCK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    twice = spark.sparkContext.broadcast(whole.tobytes())

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_twice = np.frombuffer(twice.value, np.uint8)
        for batch in slices(batches):
            keys: list[bytes] = []
            ends = []
            for text in batch.column(1).to_pylist():
                keys += long_keys(text, min_chars)
                ends.append(len(keys))
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            bit = places(keys, bits)
            passed = np.flatnonzero(
                seen_twice[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[at] for at in passed.tolist()], pa.binary()),
                    batch.column(0).take(pa.array(row[passed])),
                ],
                names=["key", "id"],
            )

    schema = T.StructType(
        [
            T.StructField("key", T.BinaryType()),
            T.StructField("id", docs.schema[id_column].dataType),
        ]
    )
    held = written(texts.mapInArrow(suspected, schema).distinct(), "suspected-lines")
    dropped = written(
        held.groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.max("id").alias("kept_in"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "kept_in"),
        "shared-lines",
    )
    return (
        held.join(dropped, "key")
        .where(~F.col("id").eqNullSafe(F.col("kept_in")))
        .groupBy("id")
        .agg(F.collect_list("key").alias("keys"))
    )


RESULT = T.StructType(
    [
        T.StructField("kept", T.BinaryType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
    ]
)


@F.arrow_udf(RESULT)
def _without(texts: pa.Array, keys: pa.Array) -> pa.Array:
    kept, n_lines, n_dropped = [], [], []
    for start in range(0, len(texts), 256):
        part = slice(start, start + 256)
        for text, gone in zip(texts[part].to_pylist(), keys[part].to_pylist()):
            lines = (text or b"").split(b"\n")
            stay = lines
            if gone:
                gone = set(gone)
                stay = [line for line in lines if key_of(line) not in gone]
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
        names=["kept", "n_lines", "n_dropped"],
    )


def without_shared_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    max_filter_bytes: int = 32 << 20,
    result: str = "line_dedup",
) -> DataFrame:
    """The documents with a struct column: text kept, n_lines before, n_dropped."""
    lost = shared_lines(docs, id_column, text_column, min_chars, min_docs, max_filter_bytes)
    lost = lost.toDF(f"{result}_id", f"{result}_keys")
    joined = docs.join(lost, docs[id_column].eqNullSafe(lost[f"{result}_id"]), "left")
    done = _without(docs[text_column].cast("binary"), lost[f"{result}_keys"])
    return joined.select(
        *[docs[f"`{name}`"] for name in docs.columns],
        done.withField("kept", done["kept"].cast("string")).alias(result),
    )
