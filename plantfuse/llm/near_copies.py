"""Near copies by the Jaccard index of their shingles, found by anchors of sampled SimHashes.

Texts are linked if their sets of shingles have an index of the least or more, and
texts linked in any way are copies of one another. Most links are found by samples
and all others by prefixes; whole sets decide each.

The SimHash of a whole text says little about an index of 0.8: a tenth of all
its bits differ then. So each text is sampled ``SAMPLES`` times. A sample is the
three shingles of least hash under one of as many orders, and its word is the
SimHash of these three, the majority of each bit. Two texts have the same sample
with a chance of about the cube of their index, 0.51 at 0.8, and one of five in
97 of 100 cases; samples of other shingles differ in 16 bits or more. Words
within two bits meet at the anchors of the covering code, as fingerprints do.

Texts whose words meet are a group. Each text of a group is compared with the
group's text of least id and with the one before it in order of size. The index
is first taken from the least ``SKETCH`` hashes of both texts together, with a
standard error of 0.018 at 0.8, and pairs that seem to reach the least index are
compared by all their hashes. These links join nearly all copies, but not all: a
pair may be neither in order nor with the least id, may share no sample, or may
seem too far apart.

So the rest is found by an exact way (``set_join``): all pairs of texts that are
not yet joined and whose prefixes and parities leave room for the least index,
however many texts a group has, are compared by all their hashes too. A text's
parities are ``PARITIES`` bits, each turned by every hash that falls to it: two
texts whose parities differ in some bits differ in as many hashes at least. No link between texts of
different words is lost. What is joined before is not compared again, so that a
large group of copies is no square of pairs.

Texts of the same words are one text from the start, however many there are. A
group's texts are spread by order of size, so that a passage that very many
documents share is no group in one task.

NULL and empty texts, and any without words, are one text. Texts of fewer words
than a shingle are one shingle. Rows of one id are compared each by its own text.
A NULL id is the least of its copies only if all ids are NULL. Other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm import set_join, simhash_cover
from plantfuse.llm.graph import components
from plantfuse.llm.shared import passing, sized_slices, text_sizes, written

#: A written table, and what removes it.
Passing = tuple[DataFrame, Callable[[], None]]

#: Words of a shingle, and the least index of a link.
SHINGLE, LEAST = 5, 0.8

#: Samples of a text, and shingles of a sample.
SAMPLES, SAMPLED = 5, 3

#: Least hashes of a text by which the index of sampled pairs is first taken.
SKETCH = 512

#: Bits of a text's parities, in longs.
PARITIES, LONG = 512, 64

#: Bytes of texts that a task works on at once.
TOGETHER = 1 << 20

#: Odd multipliers: each puts 64-bit hashes into another order.
ORDERS = (np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """A key of a text's words, and the different hashes of its shingles in order."""
    words = (text or b"").lower().split()
    line = b" ".join(words)
    key = xxhash.xxh3_128_digest(line)
    if not words:
        return key, np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    count = max(1, len(words) - SHINGLE + 1)
    ends = (starts + sizes - 1)[len(words) - count :].tolist()
    hashed = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(
        (hashed(line[start:end]) for start, end in zip(starts.tolist(), ends)), np.uint64, count
    )
    return key, np.unique(hashes)


def sample_words(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of each sample: of three hashes the majority of each bit."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    words = []
    for order in ORDERS:
        mixed = hashes * order
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        count = min(SAMPLED, len(hashes))
        least = np.argpartition(mixed, count - 1)[:count]
        a, b, c = hashes[np.resize(least[np.argsort(mixed[least])], SAMPLED)]
        words.append(a & b | a & c | b & c)
    return np.unique(np.array(words, np.uint64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of the bits, whether an odd number of hashes falls to it."""
    bits = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def may_reach(least: float) -> Column:
    """Whether the sizes and parities of two texts, one and two, leave room for the index."""
    apart = sum(
        F.bit_count(F.col("one.parities")[at].bitwiseXOR(F.col("two.parities")[at]))
        for at in range(PARITIES // LONG)
    )
    both = F.col("one.size") + F.col("two.size")
    return both - apart >= 2 * (F.lit(least / (1 + least)) * both - F.lit(set_join.SLACK))


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """The index from two texts' least hashes, in order."""
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    union = np.union1d(left, right)[:SKETCH]
    shared = np.isin(union, left, assume_unique=True) & np.isin(union, right, assume_unique=True)
    return shared.sum() / len(union)


def whole_index(left: np.ndarray, right: np.ndarray) -> float:
    """The index of two sets from all their hashes, in order."""
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return shared / (len(left) + len(right) - shared)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, key, size, words, parities): each row's text by its key and its shingles, written."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("key", T.BinaryType()),
            T.StructField("size", T.LongType()),
            T.StructField("words", T.ArrayType(T.LongType())),
            T.StructField("parities", T.ArrayType(T.LongType())),
        ]
    )

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, text_sizes, TOGETHER):
            found = [shingle_hashes(text) for text in batch.column(1).to_pylist()]
            words = [sample_words(hashes) for _, hashes in found]
            offsets = np.cumsum([0, *map(len, words)], dtype=np.int32)
            odd = np.concatenate([parities(hashes) for _, hashes in found])
            odd_offsets = np.arange(len(found) + 1, dtype=np.int32) * (PARITIES // LONG)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([key for key, _ in found], pa.binary()),
                    pa.array([len(hashes) for _, hashes in found], pa.int64()),
                    pa.ListArray.from_arrays(offsets, np.concatenate(words).view(np.int64)),
                    pa.ListArray.from_arrays(odd_offsets, odd),
                ],
                names=schema.names,
            )

    texts = docs.select(F.col(id_column), F.col(text_column).cast("binary"))
    return written(texts.mapInArrow(sampled, schema), "sampled-texts")


def _before_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each text with the one before it in its group, from sorted rows."""
    last: tuple[int, bytes] | None = None
    for batch in batches:
        groups, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        pairs = []
        for group, key in zip(groups, keys):
            if last is not None and last[0] == group and last[1] != key:
                pairs.append((min(last[1], key), max(last[1], key)))
            last = group, key
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]
        )


def _candidates(texts: DataFrame, number: int) -> Passing:
    """(a, b): pairs of keys to compare, the lesser first, written; of a number of texts."""
    most = SAMPLES * number
    members = texts.select("key", "size", "least", F.explode("words").alias("word"))
    words, drop_words = passing(members.select("word").distinct(), "sample-words", most)
    roots = components(simhash_cover.links(words))
    drop_words()
    grouped = members.join(roots, members["word"] == roots["node"], "left").select(
        "key", "size", "least", F.coalesce("root", "word").alias("group")
    )
    grouped, drop_grouped = passing(grouped.distinct(), "sample-groups", most)
    shared = (
        grouped.groupBy("group")
        .agg(F.count("*").alias("texts"), F.min(F.struct("least", "key")).alias("first"))
        .where("texts > 1")
        .select(F.col("group").alias("of_group"), "texts", F.col("first.key").alias("first"))
    )
    inside, drop_inside = passing(
        grouped.join(shared, grouped["group"] == F.col("of_group")).drop("of_group"),
        "in-groups",
        most,
    )
    drop_grouped()
    with_first = inside.where(F.col("key") != F.col("first")).select(
        F.least("key", "first").alias("a"), F.greatest("key", "first").alias("b")
    )
    order = ["group", "size", "key"]
    with_next = (
        inside.where("texts > 2")
        .select("group", "key", "size")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("group", "key")
        .mapInArrow(_before_each, "a binary, b binary")
    )
    pairs = passing(with_first.union(with_next).distinct(), "candidate-pairs", 2 * most)
    drop_inside()
    return pairs


def _hash_sets(
    docs: DataFrame,
    texts: DataFrame,
    pairs: DataFrame,
    id_column: str,
    text_column: str,
    most: int | None = None,
) -> Passing:
    """(key, hashes): all or the least hashes of every text that is to be compared."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = texts.join(wanted, "key", "left_semi").select(F.col("least").alias("of_id")).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, lambda b: text_sizes(b, 0), TOGETHER):
            found = [shingle_hashes(text) for text in batch.column(0).to_pylist()]
            least = [hashes[:most].astype("<u8").tobytes() for _, hashes in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key for key, _ in found], pa.binary()),
                    pa.array(least, pa.binary()),
                ],
                names=["key", "hashes"],
            )

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary"))
    chosen = chosen.join(ids, chosen["id"].eqNullSafe(ids["of_id"]), "left_semi").drop("id")
    sets = chosen.mapInArrow(hashed, "key binary, hashes binary")
    return passing(sets.groupBy("key").agg(F.min("hashes").alias("hashes")), "hash-sets")


def _links(
    pairs: DataFrame,
    sets: DataFrame,
    index: Callable[[np.ndarray, np.ndarray], float],
    least: float,
) -> Passing:
    """(a, b): the pairs whose index is high enough, written."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, lambda b: text_sizes(b, 2), TOGETHER):
            left, right = (batch.column(n).to_pylist() for n in (2, 3))
            high = [
                index(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= least
                for a, b in zip(left, right)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(high, pa.bool_()))

    one = sets.select(F.col("key").alias("a"), F.col("hashes").alias("left"))
    two = sets.select(F.col("key").alias("b"), F.col("hashes").alias("right"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return passing(both.mapInArrow(compared, "a binary, b binary"), "copy-links")


def _prefixes(docs: DataFrame, text_column: str, least: float) -> DataFrame:
    """(key, size, prefix): the first elements of every text that has words, written."""
    texts = docs.select(F.col(text_column).cast("binary"))

    def of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in sized_slices(batches, lambda b: text_sizes(b, 0), TOGETHER):
            found = map(shingle_hashes, batch.column(0).to_pylist())
            yield [(key, hashes) for key, hashes in found if len(hashes)]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(set_join.BUCKETS, np.int64)
        for found in of_slices(batches):
            for _, hashes in found:
                np.add.at(total, set_join.buckets(hashes), 1)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(total[bucket])], names=["bucket", "count"]
        )

    counts = set_join.counted(texts.mapInArrow(numbers, "bucket long, count long"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in of_slices(batches):
            parts = [set_join.prefix(hashes, counts, least) for _, hashes in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key for key, _ in found], pa.binary()),
                    pa.array([len(hashes) for _, hashes in found], pa.int64()),
                    pa.array([part.astype("<u8").tobytes() for part in parts], pa.binary()),
                ],
                names=["key", "size", "prefix"],
            )

    found = texts.mapInArrow(first, "key binary, size long, prefix binary")
    return found.groupBy("key").agg(F.first("size").alias("size"), F.min("prefix").alias("prefix"))


def _number(key: str) -> Column:
    """The first eight bytes of a key, as a number."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _rest(
    docs: DataFrame, texts: DataFrame, of_text: DataFrame, text_column: str, least: float
) -> Passing:
    """(a, b): all pairs of keys of different roots that may reach the index, written."""
    prefixes = _prefixes(docs, text_column, least).join(of_text.select("key", "root"), "key")
    met = set_join.pairs(
        prefixes.select(
            _number("key").alias("node"), _number("root").alias("root"), "size", "prefix"
        ),
        least,
    )
    met, drop_met = passing(met.toDF("node", "other"), "met-prefixes")
    one = texts.select(_number("key").alias("node"), F.struct("key", "size", "parities").alias("one"))
    two = texts.select(_number("key").alias("other"), F.struct("key", "size", "parities").alias("two"))
    both = met.join(one, "node").join(two, "other").where(may_reach(least))
    both = both.select(F.col("one.key").alias("a"), F.col("two.key").alias("b"))
    pairs = passing(both, "rest-pairs")
    drop_met()
    return pairs


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST
) -> DataFrame:
    """(id, component): every row's id and the least id of its copies, itself included."""
    rows = _texts(docs, id_column, text_column)
    texts = rows.groupBy("key").agg(
        F.min("id").alias("least"),
        *(F.first(name).alias(name) for name in ("size", "words", "parities")),
    )
    texts = written(texts, "different-texts", rows.count())
    number = texts.count()

    def links(found: Passing, index: Callable, most: int | None = None) -> Passing:
        pairs, drop_pairs = found
        sets, drop_sets = _hash_sets(docs, texts, pairs, id_column, text_column, most)
        high = _links(pairs, sets, index, least)
        drop_pairs()
        drop_sets()
        return high

    found, drop_found = links(links(_candidates(texts, number), jaccard, SKETCH), whole_index)
    of_text = _with_roots(texts.select("key", "least"), "key", found, found.count(), number)
    drop_found()
    rest, _ = links(_rest(docs, texts, of_text, text_column, least), whole_index)
    # A root is a key too, so that links of texts are links of their roots.
    root = of_text.select("key", F.col("root").alias("of_root"))
    joined = rest.join(root, rest["a"] == root["key"]).select("b", F.col("of_root").alias("left"))
    joined = joined.join(root, joined["b"] == root["key"]).select("left", "of_root")
    of_text = of_text.select("key", "least", F.col("root").alias("at"))
    of_text = _with_roots(of_text, "at", joined, rest.count(), number)
    firsts = of_text.groupBy("root").agg(F.min("least").alias("component"))
    firsts = written(firsts, "firsts", number)
    named = of_text.join(firsts, "root").select("key", "component")
    return rows.join(named, "key").select("id", "component")


def _with_roots(
    texts: DataFrame, column: str, found: DataFrame, links: int, number: int
) -> DataFrame:
    """(key, least, root): the texts with the root that a column reaches by links, written.

    There are no more links and texts than the two numbers.
    """
    roots = components(found, links)
    named = texts.join(roots, texts[column] == roots["node"], "left")
    named = named.select("key", "least", F.coalesce("root", column).alias("root"))
    return written(named, "text-roots", number)
