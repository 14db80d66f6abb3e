"""Alignment of two tokenizers over the bytes of the same texts.

Tokenizer A reads a space and the text, tokenizer B the text and adds the space
itself, so the tokens of both cover the same bytes. Offsets at which tokens of
both end cut them into groups; tokens that share bytes are linked. The count of
a pair of ids is the number of documents in which it is linked.

Most groups are one token of A and one of B with the same bytes. An array over
A's vocabulary names B's id of the same bytes, and documents of such pairs are
counted in vectors of the vocabulary's length, which a task sends once. Only
pairs from other groups enter a shuffle, summed by task before it.

Texts are encoded once and the ids written. The counts then go back to the
documents: the vectors and the ``HEAVY`` most frequent other pairs at most are
sent to all tasks, so a pair that a third of all documents hold is never
shuffled by its key. Pairs below that, each in few documents, are joined by key.

Texts that are NULL, empty, or whose tokens do not join to their bytes have no
tokens, no groups and no links. A row is a document, also where ids repeat or
are NULL. An empty table gives no rows. A task holds the
tokens of ``TOGETHER`` bytes of text, or of one longer text.
Columns other than the id and the text play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import sized_slices, text_lengths, text_sizes, written
from plantfuse.llm.word_ids import ID, word_ids

#: Pairs, besides those of the same bytes, whose counts are sent to all tasks.
HEAVY = 1 << 19

#: Pairs of a task that are summed there before they move.
SUMMED = 1 << 18

#: Bytes of texts, and of packed ids, that a task works on at once; more only of one text.
TOGETHER = 1 << 18

#: A pair is A's id shifted by this, plus B's; a document of a slice stands above.
B_BITS, PAIR_BITS = 20, 44
B_MASK, PAIR_MASK = (1 << B_BITS) - 1, (1 << PAIR_BITS) - 1

#: Digits of an id and the sign after it, in the rows of a table of texts.
DIGITS = 8


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for the
    characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {
        chr(0x100 + number): byte for number, byte in enumerate(others)
    }


class Vocabulary:
    """The bytes of ids, and the digits of ids for texts of groups."""

    def __init__(self, tokens: Sequence[bytes], ends: str):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # Two rows for each id: with the sign inside a group and with the last one.
        written_ids = [f"{number}{sign}" for sign in ends for number in range(len(tokens))]
        self.count = len(tokens)
        self.digits = np.array(written_ids, f"S{DIGITS}").view(np.uint8).reshape(-1, DIGITS)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.bytes[places + np.arange(len(places))].tobytes()


class Both:
    """Both tokenizers, and B's id for the bytes of each of A's."""

    def __init__(self, a_file: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.encoder = word_ids(a_file)
        self.pieces = pieces = SentencePieceProcessor(model_proto=b_model)
        of_char = byte_level()
        parts = json.loads(a_file)
        names = parts["model"]["vocab"] | {
            added["content"]: added["id"] for added in parts["added_tokens"]
        }
        added = {token["id"]: token["content"].encode() for token in parts["added_tokens"]}
        a_tokens = [b""] * (1 + max(names.values()))
        for name, number in names.items():
            a_tokens[number] = added.get(number) or bytes(map(of_char.__getitem__, name))
        numbers = range(pieces.get_piece_size())
        b_tokens = [
            bytes([int(piece[3:5], 16)])
            if pieces.is_byte(number)
            else piece.replace("▁", " ").encode()
            for number, piece in zip(numbers, map(pieces.id_to_piece, numbers))
        ]
        # How ids are packed: two bytes do for most vocabularies.
        self.kind = np.dtype("<u2" if max(len(a_tokens), len(b_tokens)) <= 1 << 16 else "<u4")
        self.a, self.b = Vocabulary(a_tokens, ",|"), Vocabulary(b_tokens, ",;")
        # Of several ids with the same bytes a whole piece goes before a single byte.
        by_bytes = {
            b_tokens[number]: number
            for number in sorted(numbers, key=lambda n: (not pieces.is_byte(n), -n))
            if not pieces.is_control(number) and not pieces.is_unknown(number)
        }
        self.same = np.array([by_bytes.get(token, -1) for token in a_tokens], np.int64)

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and B of each text; none where they do not join to its bytes."""
        a_ids = self.encoder.encode([f" {text}" for text in texts])
        b_ids = self.pieces.encode(list(texts), num_threads=1) if texts else []
        both_ids = [(np.frombuffer(a, ID), np.array(b, ID)) for a, b in zip(a_ids, b_ids)]
        wholes = [f" {text}".encode() for text in texts]
        if all(texts) and all(self._fit(side, wholes) for side in zip((self.a, self.b), zip(*both_ids))):
            return both_ids
        none = np.zeros(0, ID)
        coded = []
        for text, (a, b), whole in zip(texts, both_ids, wholes):
            fits = bool(text) and self.a.joined(a) == whole == self.b.joined(b)
            coded.append((a, b) if fits else (none, none))
        return coded

    def _fit(self, side: tuple[Vocabulary, Sequence[np.ndarray]], wholes: list[bytes]) -> bool:
        """Whether the tokens of each text join to its bytes: all have, and as many as they."""
        vocabulary, ids = side
        flat = np.concatenate(ids)
        sizes = np.concatenate([[0], np.cumsum(vocabulary.sizes[flat])])
        ends = sizes[np.cumsum([len(of_text) for of_text in ids])]
        return np.array_equal(ends, np.cumsum([len(whole) for whole in wholes])) and (
            vocabulary.joined(flat) == b"".join(wholes)
        )


@lru_cache(maxsize=2)
def both(a_file: str, b_model: bytes) -> Both:
    """The worker's own of two files."""
    return Both(a_file, b_model)


class Links(NamedTuple):
    """Links in order of bytes over a slice of documents, with ids as 64-bit numbers.

    A link ends where a token of A does, or one of B, or both.
    """

    a: np.ndarray
    b: np.ndarray
    a_counts: np.ndarray
    b_counts: np.ndarray
    a_here: np.ndarray
    b_here: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        return self.a[self.left] << B_BITS | self.b[self.right]


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """A column of packed ids as one array, and how many each row has."""
    lengths = text_lengths(column) // kind.itemsize
    packed = b"".join(column.to_pylist())
    return np.frombuffer(packed, kind).astype(np.int64), lengths


def links(a: pa.Array, b: pa.Array, vocabularies: Both) -> Links:
    """All links of a slice: between two neighbouring ends lies one token of each."""
    (a_ids, a_counts), (b_ids, b_counts) = (_flat(side, vocabularies.kind) for side in (a, b))
    a_ends = np.cumsum(vocabularies.a.sizes[a_ids])
    b_ends = np.cumsum(vocabularies.b.sizes[b_ids])
    # Both cover the same bytes, and each byte is marked if a token ends there.
    a_at, b_at = (np.zeros(1 + max(a_ends[-1:], default=0), bool) for _ in range(2))
    a_at[a_ends], b_at[b_ends] = True, True
    ends = np.flatnonzero(a_at | b_at)
    a_here, b_here = a_at[ends], b_at[ends]
    left, right = np.cumsum(a_here) - a_here, np.cumsum(b_here) - b_here
    doc = np.repeat(np.arange(len(a_counts)), a_counts)[left]
    return Links(a_ids, b_ids, a_counts, b_counts, a_here, b_here, left, right, doc)


def texts_of_groups(found: Links, ids: Both) -> list[str]:
    """Each document's groups, as ``a1,a2|b1;a3|b2,b3``."""
    common = found.a_here & found.b_here
    group = np.cumsum(common) - common
    a_group, b_group = group[found.a_here], group[found.b_here]
    # A token's place: after the tokens of its own kind and those of earlier
    # groups, for one of B also after the group's tokens of A.
    a_until, b_until = found.left[common] + 1, found.right[common] + 1
    a_place = np.arange(len(a_group)) + np.concatenate([[0], b_until])[a_group]
    b_place = np.arange(len(b_group)) + a_until[b_group]
    last_a, last_b = common[found.a_here], common[found.b_here]
    rows = np.empty((len(a_place) + len(b_place), DIGITS), np.uint8)
    rows[a_place] = ids.a.digits[found.a + ids.a.count * last_a]
    rows[b_place] = ids.b.digits[found.b + ids.b.count * last_b]
    filled = rows != 0
    whole = rows[filled].tobytes().decode()
    sizes = np.concatenate([[0], np.cumsum(filled.sum(1))])
    stops = sizes[np.cumsum(found.a_counts + found.b_counts)].tolist()
    return [whole[start : max(start, stop - 1)] for start, stop in zip([0, *stops], stops)]


def encoded(
    docs: DataFrame, a_path: str, b_path: str, id_column: str, text_column: str
) -> tuple[DataFrame, object]:
    """(row, id, a, b): the packed ids by both, written; and both files, sent to the tasks."""
    files = docs.sparkSession.sparkContext.broadcast(
        (Path(a_path).read_text("utf-8"), Path(b_path).read_bytes())
    )
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("a", T.BinaryType()),
            T.StructField("b", T.BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = both(*files.value)
        for batch in sized_slices(batches, text_sizes, TOGETHER):
            coded = vocabularies.encode([text or "" for text in batch.column(1).to_pylist()])
            packed = [
                pa.array([ids.astype(vocabularies.kind).tobytes() for ids in side], pa.binary())
                for side in zip(*coded)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], names=schema.names)

    coded = docs.select(id_column, text_column).mapInArrow(encode, schema)
    return written(
        coded.select(F.monotonically_increasing_id().alias("row"), "*"), "token-ids"
    ), files


def pair_counts(coded: DataFrame, files) -> DataFrame:
    """(pair, same, documents): how many documents hold each pair linked, written.

    ``same`` marks pairs of the same bytes, which the tasks counted in vectors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = both(*files.value)
        same = vocabularies.same
        vector = np.zeros(len(same), np.int64)
        pairs, documents = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def rows(pairs: np.ndarray, same: bool, documents: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs), pa.array(np.full(len(pairs), same)), pa.array(documents)],
                names=["pair", "same", "documents"],
            )

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, at = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True)
            weights = np.concatenate([documents, *(np.ones(len(w), np.int64) for w in waiting)])
            total = np.zeros(len(new), np.int64)
            np.add.at(total, at, weights)
            return new, total

        for batch in sized_slices(batches, lambda b: text_sizes(b, 0), TOGETHER):
            found = links(batch.column(0), batch.column(1), vocabularies)
            identity = same[found.a[found.left]] == found.b[found.right]
            regular = np.unique(found.doc[identity] << PAIR_BITS | found.a[found.left[identity]])
            vector += np.bincount(regular & PAIR_MASK, minlength=len(vector))
            other = np.unique(found.doc[~identity] << PAIR_BITS | found.pairs[~identity])
            waiting.append(other & PAIR_MASK)
            if sum(map(len, waiting)) > SUMMED:
                (pairs, documents), waiting = summed(), []
                if len(pairs) > SUMMED:
                    yield rows(pairs, False, documents)
                    pairs, documents = pairs[:0], documents[:0]
        yield rows(*(lambda p, d: (p, False, d))(*summed()))
        held = np.flatnonzero(vector)
        yield rows(held << B_BITS | same[held], True, vector[held])

    counted = coded.select("a", "b").mapInArrow(count, "pair long, same boolean, documents long")
    summed = counted.groupBy("pair", "same").agg(F.sum("documents").alias("documents"))
    return written(summed, "pair-counts")


def _arrays(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of numbers, in order of the first; their rows are bounded."""
    rows = frame.toArrow()
    keys, values = (rows.column(n).to_numpy().astype(np.int64) for n in (0, 1))
    order = np.argsort(keys)
    return keys[order], values[order]


def _heavy_from(others: DataFrame, heavy: int) -> int:
    """The least power of two such that at most ``heavy`` pairs are in as many documents."""
    sizes = others.groupBy(F.floor(F.log2("documents")).alias("power")).count().collect()
    number, least = 0, 0
    for power, count in sorted(sizes, reverse=True):
        number += count
        if number > heavy:
            return 1 << power + 1
        least = power
    return 1 << least


def aligned(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    heavy: int = HEAVY,
) -> DataFrame:
    """Per row: id, a and b (the ids), groups (their text), and counts of links.

    ``n_groups`` and ``n_links`` are numbers; ``n_best`` is the number of links
    whose pair has the highest count of all pairs of its id of A, ties
    included; ``count_sum`` is the sum of the counts of all links.
    """
    spark = docs.sparkSession
    coded, files = encoded(docs, a_path, b_path, id_column, text_column)
    pairs = pair_counts(coded, files)
    of_a = F.shiftright("pair", B_BITS)
    best = pairs.groupBy(of_a.alias("of_a")).agg(F.max("documents").alias("most"))
    others = pairs.where(~F.col("same"))
    least = _heavy_from(others, heavy)
    light = others.where(F.col("documents") < least)
    known = spark.sparkContext.broadcast(
        (
            _arrays(best),
            _arrays(
                pairs.where(F.col("same") | (F.col("documents") >= least)).select(
                    "pair", "documents"
                )
            ),
        )
    )
    counts = T.StructType(
        [T.StructField(name, T.LongType()) for name in ("n_groups", "n_links", "n_best")]
        + [T.StructField("count_sum", T.LongType())]
    )
    rest = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("pair", "times")]))
    ids = T.ArrayType(T.IntegerType())
    kept = T.StructType(
        [coded.schema["row"], coded.schema["id"], T.StructField("a", ids), T.StructField("b", ids)]
        + [T.StructField("groups", T.StringType()), *counts, T.StructField("rest", rest)]
    )

    def lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, ids.astype(np.int32))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = both(*files.value)
        (best_a, most), (known_pairs, known_documents) = known.value
        highest = np.zeros(len(vocabularies.same), np.int64)
        highest[best_a] = most
        # Pairs of the same bytes are looked up by A's id, only others searched for.
        same = vocabularies.same
        is_same = same[known_pairs >> B_BITS] == known_pairs & B_MASK
        of_same = np.zeros(len(same), np.int64)
        of_same[known_pairs[is_same] >> B_BITS] = known_documents[is_same]
        other_pairs, other_documents = known_pairs[~is_same], known_documents[~is_same]
        for batch in sized_slices(batches, lambda b: text_sizes(b, 2), TOGETHER):
            rows = batch.num_rows
            found = links(batch.column(2), batch.column(3), vocabularies)
            group_doc = found.doc[found.a_here & found.b_here]
            pairs, of_a = found.pairs, found.a[found.left]
            there = same[of_a] == found.b[found.right]
            documents = np.where(there, of_same[of_a], 0)
            if len(other_pairs):
                others = np.flatnonzero(~there)
                wanted = pairs[others]
                at = np.minimum(np.searchsorted(other_pairs, wanted), len(other_pairs) - 1)
                hit = other_pairs[at] == wanted
                there[others[hit]], documents[others[hit]] = True, other_documents[at[hit]]
            is_best = there & (documents == highest[of_a])

            ends = np.searchsorted(found.doc, np.arange(rows + 1))

            def total(of_links: np.ndarray) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(of_links, dtype=np.int64)])
                return pa.array(np.diff(sums[ends]))

            left_out, times = np.unique(
                found.doc[~there] << PAIR_BITS | pairs[~there], return_counts=True
            )
            starts = np.searchsorted(left_out >> PAIR_BITS, np.arange(rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    lists(found.a, found.a_counts),
                    lists(found.b, found.b_counts),
                    pa.array(texts_of_groups(found, vocabularies), pa.string()),
                    pa.array(np.bincount(group_doc, minlength=rows)),
                    pa.array(np.diff(ends)),
                    total(is_best),
                    total(documents),
                    pa.ListArray.from_arrays(
                        starts,
                        pa.StructArray.from_arrays(
                            [pa.array(left_out & PAIR_MASK), pa.array(times)], ["pair", "times"]
                        ),
                    ),
                ],
                names=kept.names,
            )

    measured = coded.mapInArrow(measure, kept)
    if least == 1:
        return measured.drop("row", "rest")
    # A light pair is in fewer than ``least`` documents, so no key is hot.
    light = light.join(best, of_a == F.col("of_a")).select(
        F.col("pair").alias("light"),
        "documents",
        (F.col("documents") == F.col("most")).cast("long").alias("best"),
    )
    measured = written(measured, "aligned")
    of_rows = (
        measured.select("row", F.inline("rest"))
        .join(light, F.col("pair") == F.col("light"))
        .groupBy(F.col("row").alias("of_row"))
        .agg(
            F.sum(F.col("times") * F.col("best")).alias("more_best"),
            F.sum(F.col("times") * F.col("documents")).alias("more_sum"),
        )
    )
    return measured.join(of_rows, measured["row"] == F.col("of_row"), "left").select(
        "id",
        "a",
        "b",
        "groups",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
