"""Joins reduced by a filter of keys.

The keys of the smaller side go into a Bloom filter, an array of BIGINT words
sized from their number, which the other side's rows are looked up in where they
are read. Only rows that may have a partner are shuffled to the exact join. The
filter is a scalar subquery, so it reaches all tasks once and the look-up stays
in the filter of the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key and probes: one in a hundred other keys passes.
BITS_PER_KEY, PROBES = 10, 7

#: Words of a filter at most, 4 MB. With more keys than these serve, more of the
#: other rows pass; the exact join follows in any case.
MOST_WORDS = 1 << 19


def _positions(keys: Sequence[Column], bits: int) -> list[Column]:
    """The bits of a key, from two hashes of it."""
    first, second = F.xxhash64(*keys), F.xxhash64(*keys, F.lit(1))
    return [F.pmod(first.bitwiseXOR(F.shiftleft(second, n)), F.lit(bits)) for n in range(PROBES)]


def filter_words(keys: int) -> int:
    """Words of a filter for so many keys: a power of two."""
    return min(MOST_WORDS, 1 << max(0, (keys * BITS_PER_KEY // 64).bit_length()))


def key_filter(frame: DataFrame, key: Sequence[str], words: int) -> DataFrame:
    """One row: the words of the filter of a frame's keys, in order.

    Each task joins the bits of its rows before they move, so what moves is at
    most the filter for each task. Rows with a NULL in the key join nothing.
    """
    columns = [F.col(f"`{c}`") for c in key]
    bits = frame.dropna(subset=list(key)).select(
        F.explode(F.array(*_positions(columns, 64 * words))).alias("bit")
    )
    held = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")
    )
    every = frame.sparkSession.range(words).select(F.col("id").alias("word"))
    dense = every.join(held, "word", "left").select(
        F.struct("word", F.coalesce("set", F.lit(0)).alias("set")).alias("of")
    )
    return dense.agg(F.array_sort(F.collect_list("of"))["set"].alias("words"))


def may_hold(found: Column, key: Sequence[Column], words: int) -> Column:
    """Whether a filter may hold a key; never false for one that it holds."""

    def is_set(bit: Column) -> Column:
        word = F.get(found, F.shiftright(bit, 6).cast("int"))
        place = bit.bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftright", word, place).bitwiseAND(F.lit(1)) == 1

    return reduce(Column.__and__, map(is_set, _positions(key, 64 * words)))


def with_partner(
    frame: DataFrame,
    key: Sequence[str],
    smaller: DataFrame,
    smaller_key: Sequence[str],
    keys: int | None = None,
) -> DataFrame:
    """The rows of a frame whose key the smaller side may hold.

    Of other rows about one in a hundred stays, so an exact join must follow.
    The smaller side is counted for the filter's size unless its number of keys
    is given, and read once more for the filter.
    """
    words = filter_words(smaller.count() if keys is None else keys)
    found = key_filter(smaller, smaller_key, words).scalar()
    return frame.where(may_hold(found, [F.col(f"`{c}`") for c in key], words))
