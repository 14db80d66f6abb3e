"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, at i, the sum of c[j] * B**j over its first i
code points, modulo a prime, for two bases. Any span's hash follows from two of
its entries, so two spans are compared in constant time and the longest common
extension of two places is found by binary search. A prefix array is extended
by further code points without visiting the earlier ones.

A text's fingerprint is the hash of the whole text and the ``KEPT`` least mixed
hashes of its spans of ``span_of(n)`` code points. The likeness of two
texts is the share of the least hashes of both that both have, which
estimates the Jaccard index of their multisets of spans: exactly for texts of up
to ``KEPT`` spans, with a standard error of under 0.03 for longer ones.
Both texts' hashes are taken at the span length of the lesser text, which the
prefix arrays give too, so that texts on two sides of a change of ``span_of``
are compared like any others.

NULL counts as empty. An empty text has no spans: its likeness to another empty
text is 1, to any other 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import slices

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253)
KEPT = 256
#: Odd, so that mixing loses nothing: 2**64 divided by the golden ratio.
MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of text in one range of ids, and ranges at most.
RANGE_BYTES = 16 << 20
RANGES = 100_000


def span_of(n_chars: int) -> int:
    """Code points of a span: shorter for texts that have few."""
    for span, least in ((16, 64), (8, 32), (4, 16)):
        if n_chars >= least:
            return span
    return 2


def reduced(numbers: np.ndarray) -> np.ndarray:
    """The numbers, below 2**63, modulo the prime, which is one less than a power of two."""
    prime = np.uint64(PRIME)
    numbers = (numbers & prime) + (numbers >> np.uint64(31))
    numbers = (numbers & prime) + (numbers >> np.uint64(31))
    numbers[numbers == prime] = 0
    return numbers


class Powers:
    """Powers of a base and of its inverse, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.steps = (base, pow(base, -1, PRIME))
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, count: int) -> list[np.ndarray]:
        while len(self.known[0]) < count:
            size = len(self.known[0])
            self.known = [
                np.concatenate([known, reduced(known * np.uint64(pow(step, size, PRIME)))])
                for known, step in zip(self.known, self.steps)
            ]
        return self.known


POWERS = tuple(Powers(base % PRIME) for base in BASES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix arrays of one text, one for each base."""

    def __init__(self, codes: np.ndarray, known: list[np.ndarray] | None = None):
        """``known``: prefix arrays of the first code points, if there are any."""
        self.size = len(codes)
        self.sums = []
        for number, powers in enumerate(POWERS):
            sums = known[number] if known else np.zeros(1, np.uint64)
            start = len(sums) - 1
            # One more than a code point, so that leading zeros count.
            terms = (codes[start:] + 1) * powers.upto(self.size + 1)[0][start : self.size]
            added = reduced(sums[-1] + np.cumsum(reduced(terms)))
            self.sums.append(np.concatenate([sums, added]))

    def edited(self, codes: np.ndarray, kept: int) -> PrefixHash:
        """The prefix arrays of a text that shares its first ``kept`` code points."""
        return PrefixHash(codes, [sums[: kept + 1] for sums in self.sums])

    def span(self, start: int, stop: int) -> tuple[int, ...]:
        """The hash of a span, the same wherever the span stands."""
        return tuple(
            (int(sums[stop]) - int(sums[start])) * int(powers.upto(start + 1)[1][start]) % PRIME
            for sums, powers in zip(self.sums, POWERS)
        )

    def spans(self, length: int) -> np.ndarray:
        """The mixed hashes of all spans of one length, in order, as 32 bits."""
        length = min(length, self.size)
        count = self.size - length + 1 if length else 0
        parts = [
            reduced((sums[length:] + (PRIME - sums[:count])) * powers.upto(count)[1][:count])
            for sums, powers in zip(self.sums, POWERS)
        ]
        return ((parts[0] << np.uint64(31) | parts[1]) * MIX >> np.uint64(32)).astype(np.uint32)

    def extension(self, at: int, other: PrefixHash, there: int) -> int:
        """The length of the longest common extension of two places."""
        low, high = 0, min(self.size - at, other.size - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, at + middle) == other.span(there, there + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def least(self) -> Least:
        """The least hashes of the text's spans."""
        return Least(self)

    def least_of(self, length: int) -> np.ndarray:
        """The least hashes of the text's spans of one length, in order.

        A span's further occurrences count as spans of their own, so that a
        repetitive text is as like to its parts as any other.
        """
        hashes = np.sort(self.spans(length))
        place = np.arange(len(hashes))
        new = np.diff(hashes, prepend=hashes[:1] + np.uint32(1)) != 0
        times = place - np.maximum.accumulate(np.where(new, place, 0))
        mixed = (hashes | times.astype(np.uint64) << np.uint64(32)) * MIX
        mixed = ((mixed ^ mixed >> np.uint64(29)) * MIX >> np.uint64(32)).astype(np.uint32)
        bound = (8 * KEPT << 32) // max(1, len(mixed))
        few = np.unique(mixed[mixed < bound] if bound < 1 << 32 else mixed)
        return (few if len(few) >= KEPT else np.unique(mixed))[:KEPT]


class Least:
    """A text's least hashes, for each length of spans that is asked for."""

    def __init__(self, prefix: PrefixHash):
        self.prefix = prefix
        self.size = prefix.size
        self.known: dict[int, np.ndarray] = {}

    def of(self, size: int) -> np.ndarray:
        """The hashes of spans as a text of ``size`` code points has them."""
        length = min(span_of(size), size)
        if length not in self.known:
            self.known[length] = self.prefix.least_of(length)
        return self.known[length]


def fingerprint_text(prefix: PrefixHash, least: Least) -> str:
    """The whole text's hash and the least hashes, in hexadecimal digits."""
    whole = "".join(f"{part:08x}" for part in prefix.span(0, prefix.size))
    return whole + least.of(prefix.size).astype(">u4").tobytes().hex()


def likeness(one: Least, other: Least) -> float:
    """The share of the least hashes of both that both have; 1 for two empty texts."""
    size = min(one.size, other.size)
    if not size:
        return float(one.size == other.size)
    one, other = one.of(size), other.of(size)
    both = np.union1d(one, other)[:KEPT]
    return float(np.isin(both, np.intersect1d(one, other)).mean())


class Hashed:
    """A document and what its fingerprint is made of."""

    def __init__(self, key: object, text: str | None):
        self.key = key
        self.text = text or ""
        self.codes = code_points(self.text)
        self.prefix = PrefixHash(self.codes)
        self.least = self.prefix.least()


def compared(doc: Hashed, following: Hashed) -> tuple:
    """A document beside its edited text and beside the one that follows."""
    size = doc.prefix.size
    kept = size - size // 4
    head = following.text[: size // 4]
    edited = doc.prefix.edited(
        np.concatenate([doc.codes[:kept], following.codes[: size // 4]]), kept
    )
    least = edited.least()
    return (
        doc.key,
        size,
        hashlib.sha256((doc.text[:kept] + head).encode("utf-8", "surrogatepass")).hexdigest(),
        fingerprint_text(doc.prefix, doc.least),
        fingerprint_text(edited, least),
        likeness(doc.least, least),
        likeness(doc.least, following.least),
        doc.prefix.extension(0, edited, 0),
        doc.prefix.extension(0, following.prefix, 0),
    )


def _schema(id_type: T.DataType) -> T.StructType:
    fields = [
        ("n_chars", T.LongType()),
        ("edited_sha256", T.StringType()),
        ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()),
        ("near_edited", T.DoubleType()),
        ("near_next", T.DoubleType()),
        ("same_start_edited", T.LongType()),
        ("same_start_next", T.LongType()),
    ]
    return T.StructType(
        [T.StructField("id", id_type)] + [T.StructField(name, kind) for name, kind in fields]
    )


def compared_with_next(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Each document's fingerprint, and those of its edited text and of the next document.

    Documents follow each other by ascending numeric id, NULL first; rows with
    the same id by their texts; after the last comes the first. The edited text
    has the last quarter of its code points replaced by the next document's
    first ones.

    Texts move once: to ranges of ids, whose bounds are quantiles, so that no
    task orders more than a range. Each range also gets a copy of the document
    that follows its last one. ``same_start_*`` are common prefix lengths.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(RANGES, 1 + n_bytes // RANGE_BYTES))

    # As a double an id may lose its last digits, but never its place in order.
    texts = texts.withColumn("place", F.coalesce(F.col("id").cast("double"), F.lit(-np.inf)))
    cuts = []
    if ranges > 1:
        cuts = texts.where("id IS NOT NULL").approxQuantile(
            "place", [n / ranges for n in range(1, ranges)], 1 / (8 * ranges)
        )
    splits = [-np.inf, *sorted(set(cuts) - {-np.inf, np.inf}), np.inf]
    if len(splits) == 2:
        ranged = texts.withColumn("part", F.lit(0))
    else:
        bucketizer = Bucketizer(splits=splits, inputCol="place", outputCol="range_number")
        ranged = bucketizer.transform(texts).withColumn("part", F.col("range_number").cast("int"))
    ranged = ranged.select("id", "text", "part")

    # One row for each range: its first id, which also goes to the range before.
    firsts = (
        ranged.groupBy("part")
        .agg(F.min(F.struct(F.col("id").isNotNull().alias("given"), "id")).alias("first"))
        .orderBy("part")
        .select("part", "first.id")
        .collect()
    )
    heads = spark.createDataFrame(
        [(row.id, firsts[number - 1].part) for number, row in enumerate(firsts)],
        T.StructType(
            [
                T.StructField("first", texts.schema["id"].dataType),
                T.StructField("before", T.IntegerType()),
            ]
        ),
    )
    own = F.struct("part", F.lit(False).alias("copy"))
    before = F.struct(F.col("before").alias("part"), F.lit(True).alias("copy"))
    to = F.when(F.isnull("before"), F.array(own)).otherwise(F.array(own, before))
    dealt = ranged.join(
        F.broadcast(heads), F.col("id").eqNullSafe(F.col("first")), "left"
    ).select("id", "text", F.explode(to).alias("to"))
    schema = _schema(texts.schema["id"].dataType)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in slices(batches, 64):
            rows = []
            for key, text, number, copy in zip(*(column.to_pylist() for column in batch.columns)):
                if number != part:
                    part, held = number, None
                if copy and held is None:
                    continue  # a further row with the next range's first id
                doc = Hashed(key, text)
                if held is not None:
                    rows.append(compared(held, doc))
                held = None if copy else doc
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), *map(pa.array, columns[1:])],
                    names=schema.fieldNames(),
                )

    return (
        dealt.select("id", "text", "to.part", "to.copy")
        .repartitionById(ranges, F.col("part"))
        .sortWithinPartitions("part", "copy", "id", "text")
        .mapInArrow(beside, schema)
    )
