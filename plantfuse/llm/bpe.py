"""Byte-level BPE encoding and decoding by a table of ranks.

A text is split by a pattern and each piece's bytes are merged on their own. A
segment tree over the byte positions of a piece holds, at each live position,
the rank of the pair that starts there; its root is the leftmost pair of least
rank. A merge changes three positions, each in logarithmic time, so a piece of
n bytes takes n log n steps however long it is. Short pieces that a task has not
met lately are merged together: their trees are the rows of one array, and each
step merges one pair in every row.

NULL and empty texts have no ids. Any string decodes to its own UTF-8 bytes.
Rows are independent: ties, repeated rows and other columns play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plantfuse.llm.shared import slices

#: Pieces whose ids a task remembers before it forgets all of them.
REMEMBERED = 400_000

#: Pieces up to this many bytes are merged in rows of one array, longer ones alone.
SHORT = 64

#: How ids are kept.
ID = np.dtype(np.int32)

#: Above any node of a tree: no pair here is a token.
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file with a base64 token and its id per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class PairTree:
    """Leftmost minimum of pair ranks over byte positions, with point updates.

    A node holds rank * width + position, so the lesser number is the lower
    rank and, between equal ranks, the position further left.
    """

    def __init__(self, ranks: Sequence[int | None]):
        self.width = len(ranks)
        self.nodes = [0] * self.width + [
            NONE if rank is None else rank * self.width + at for at, rank in enumerate(ranks)
        ]
        nodes = self.nodes
        for node in range(self.width - 1, 0, -1):
            left, right = nodes[2 * node], nodes[2 * node + 1]
            nodes[node] = left if left < right else right

    def put(self, at: int, rank: int | None) -> None:
        nodes = self.nodes
        node = self.width + at
        value = NONE if rank is None else rank * self.width + at
        nodes[node] = value
        while node > 1:
            other = nodes[node ^ 1]
            node >>= 1
            least = value if value < other else other
            if nodes[node] == least:
                return
            nodes[node] = value = least

    def leftmost(self) -> int | None:
        """The position of the leftmost pair of least rank, or None."""
        root = self.nodes[1]
        return None if root == NONE else root % self.width


class PairForest:
    """Trees over many short pieces at once, one row each, all of one width.

    While merging, every part of a piece is a token, so a pair of token ids
    finds the rank that their joined bytes have.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks.get(bytes([byte]), -1) for byte in range(256)])
        self.ids = 1 + max(ranks.values(), default=0)
        pairs = [
            (ranks[token[:cut]] * self.ids + ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        pairs.sort()
        self.keys, self.merged = np.array([*pairs, (NONE, 0)], np.int64).T.copy()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where they join to no token."""
        key = left * self.ids + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def merge(self, pieces: Sequence[bytes], width: int) -> list[bytes]:
        """The ids of each piece, packed; none is longer than ``width``, a power of two."""
        count = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, count)
        place = np.arange(width)
        live = place < sizes[:, None]
        ids = np.full((count, width), -1, np.int64)
        ids[live] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.broadcast_to(place + 1, (count, width)), sizes[:, None])
        before = np.broadcast_to(place - 1, (count, width)).copy()

        nodes = np.full((count, 2 * width), NONE, np.int64)
        first = self.ranks_of(ids[:, :-1], ids[:, 1:])
        nodes[:, width:-1] = np.where(first >= 0, first * width + place[:-1], NONE)
        level = width
        while level > 1:
            half = level // 2
            nodes[:, half:level] = np.minimum(
                nodes[:, level : 2 * level : 2], nodes[:, level + 1 : 2 * level : 2]
            )
            level = half

        # From here all arrays are flat; a row's places begin at its base.
        live, ids, after, before = live.ravel(), ids.ravel(), after.ravel(), before.ravel()
        nodes, base = nodes.ravel(), np.arange(count) * width
        while True:
            root = nodes[2 * base + 1]
            going = np.flatnonzero(root < NONE)
            if not len(going):
                break
            base, root, sizes = base[going], root[going], sizes[going]
            tree, at, rank = 2 * base, root % width, root // width
            gone = after[base + at]
            end = after[base + gone]
            left = before[base + at]
            after[base + at] = end
            live[base + gone] = False
            ids[base + at] = rank
            more = end < sizes
            before[(base + end)[more]] = at[more]

            right = np.where(more, ids[base + np.where(more, end, 0)], -1)
            pair = self.ranks_of(rank, right)
            nodes[tree + width + gone] = NONE
            nodes[tree + width + at] = np.where(pair >= 0, pair * width + at, NONE)
            has_left = left >= 0
            left = np.where(has_left, left, at)
            pair = self.ranks_of(np.where(has_left, ids[base + left], -1), rank)
            leaf = np.where(pair >= 0, pair * width + left, NONE)
            nodes[(tree + width + left)[has_left]] = leaf[has_left]

            changed = [gone + width, at + width, left + width]
            for _ in range(width.bit_length() - 1):
                for path, node in enumerate(changed):
                    below = tree + (node & -2)
                    changed[path] = node >> 1
                    nodes[tree + (node >> 1)] = np.minimum(nodes[below], nodes[below + 1])
        ends = np.cumsum(live.reshape(count, width).sum(1)) * ID.itemsize
        packed, ends = ids[live].astype(ID).tobytes(), ends.tolist()
        return [packed[start:stop] for start, stop in zip([0, *ends], ends)]


class Tokenizer:
    """Encodes and decodes by ranks; pieces lately seen are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.sizes = np.zeros(1 + max(ranks.values(), default=0), np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        self.longest = max(map(len, ranks), default=0)
        self.split = regex.compile(pattern).findall
        self.forest = PairForest(ranks)
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, get, longest = len(piece), self.ranks.get, self.longest
        tree = PairTree([get(piece[at : at + 2]) for at in range(size)])
        tree.put(size - 1, None)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        while (at := tree.leftmost()) is not None:
            gone = after[at]
            end = after[at] = after[gone]
            tree.put(gone, None)
            if end < size:
                before[end] = at
                stop = after[end]
                tree.put(at, get(piece[at:stop]) if stop - at <= longest else None)
            else:
                tree.put(at, None)
            if at:
                left = before[at]
                tree.put(left, get(piece[left:end]) if end - left <= longest else None)
        ids, at = [], 0
        while at < size:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def learn(self, pieces: Iterable[str]) -> None:
        """Remembers the ids of pieces."""
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            token = piece.encode()
            whole = self.ranks.get(token)
            if whole is not None:
                self.known[piece] = ID.type(whole).tobytes()
            elif len(token) > SHORT:
                self.known[piece] = np.array(self.merge(token), ID).tobytes()
            else:
                width = 1 << (len(token) - 1).bit_length()
                alike = by_width.setdefault(width, ([], []))
                alike[0].append(piece)
                alike[1].append(token)
        for width, (alike, tokens) in by_width.items():
            self.known.update(zip(alike, self.forest.merge(tokens, width)))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        pieces = [self.split(text) for text in texts]
        self.learn(set(chain.from_iterable(pieces)).difference(self.known))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, of_text)), ID) for of_text in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - ends + sizes, sizes)
        places += np.arange(len(places))
        return self.bytes[places].tobytes()


def round_trip(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: its id, the token ids of the whole text, and the bytes they decode to.

    The rank file, whose size is that of a vocabulary, is read on the driver
    and sent to the executors once.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.BinaryType()),
        ]
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks.value, pattern)
        for batch in slices(batches):
            ids = tokenizer.encode([text or "" for text in batch.column(1).to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(offsets, np.concatenate(ids)),
                    pa.array(map(tokenizer.decode, ids), pa.binary()),
                ],
                names=["id", "ids", "decoded"],
            )

    return docs.select(id_column, text_column).mapInArrow(coded, schema)
