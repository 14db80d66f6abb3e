"""Ranked lexical search by a pipeline of term owners.

Documents are read once: each leaves its number of terms and how often it holds
any of the items' terms. Owners hold terms, each its share of all the items'
terms, rarest first. A bundle carries the accumulators of some items over one
bucket of documents from owner to owner. At each it meets the postings of the
owner's terms in the same bucket by a cogroup, and every term adds its integer
contribution. At the last owner each bundle also meets the ids of its documents
and selects the best, and the best of all bundles are ranked.

Bundles and buckets are of bounded size, so no group grows with the input, and a
term that a third of all documents hold is spread over all their buckets. An
accumulator is carried only while it may still win. After each owner the least
of an item's best scores so far is a bound from below: contributions are never
negative. The greatest contributions of the terms to come, taken from the
postings, bound from above what a document can still gain. With the rarest
terms first, most documents of the common ones never get an accumulator. The
ranking is that of all accumulators.

Items are a query set of any size: they are searched in blocks of ``BLOCK``
item terms, which is what the driver and a task hold of them. All blocks use
the same reading of the documents.

Terms are runs of letters, digits and all code points above U+007F; only A-Z are
lower-cased. NULL texts have none. A row of documents is a document, also where
ids repeat or are NULL; of equal scores the least id comes first, NULL before
all, and rows of one id in any order. Rows of one item id, NULL too, are one
item with the terms of all. Items without terms, or with none that any document
holds, have no rows, as have empty tables. Other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import slices, written

#: Fixed values of the score: the scale of its integers, and how much of a
#: document's length counts, in hundredths.
SCALE, LENGTH_SHARE = 1000, 90

#: Owners that a bundle passes, items of a bundle, documents of a bucket.
OWNERS, BUNDLE, BUCKET = 3, 128, 4096

#: Terms of items held at once by the driver and by a task.
BLOCK = 1 << 20

#: Hashes of items' terms by which documents' terms are looked over, 8 bytes each.
#: Beyond so many terms every term of a document is kept until the exact join.
LOOKED_FOR = 1 << 22

#: Runs of anything but the other ASCII characters.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, in order and with repeats."""
    return TERM.findall((text or "").translate(LOWER))


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, term): the different terms of each item, written."""
    schema = T.StructType(
        [
            T.StructField("item", items.schema[id_column].dataType),
            T.StructField("term", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(set(terms_of(text))) for text in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(terms) for terms in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array([term for terms in found for term in terms], pa.string()),
                ],
                names=["item", "term"],
            )

    cut_up = items.select(id_column, text_column).mapInArrow(cut, schema).distinct()
    return written(cut_up, "item-terms")


def term_counts(
    docs: DataFrame, terms: DataFrame, id_column: str, text_column: str
) -> DataFrame:
    """(row, id, n, terms, tfs): each document's length and its counts of items' terms.

    Written once; ``row`` is a number of the written row, and rows of one
    bucket stand together.
    """
    wanted = terms.select("term").distinct()
    few = wanted.limit(LOOKED_FOR + 1).count() <= LOOKED_FOR
    hashed = [_hash(row.term) for row in wanted.toLocalIterator()] if few else None
    looked_for = docs.sparkSession.sparkContext.broadcast(
        None if hashed is None else np.sort(np.array(hashed, np.int64))
    )
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("tfs", T.ArrayType(T.LongType())),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = looked_for.value
        # Whether a term is looked for, of the terms that a task has met lately.
        met: dict[str, bool] = {}
        for batch in slices(batches):
            counted = [Counter(terms_of(text)) for text in batch.column(1).to_pylist()]
            lengths = [counts.total() for counts in counted]
            if keys is not None:
                if len(met) > 1 << 20:
                    met.clear()
                new = [*set().union(*counted).difference(met)]
                hashes = np.fromiter(map(_hash, new), np.int64, len(new))
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(new), bool)
                met.update(zip(new, hit.tolist()))
                counted = [{t: n for t, n in counts.items() if met[t]} for counts in counted]
            offsets = np.cumsum([0, *map(len, counted)], dtype=np.int32)
            terms = pa.array([term for counts in counted for term in counts], pa.string())
            tfs = pa.array([tf for counts in counted for tf in counts.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, terms),
                    pa.ListArray.from_arrays(offsets, tfs),
                ],
                names=schema.names,
            )

    counted = docs.select(id_column, text_column).mapInArrow(count, schema)
    return written(counted.select(F.monotonically_increasing_id().alias("row"), "*"), "term-counts")


class Plan(NamedTuple):
    """What a block's owners know. Items and terms are numbered within the block."""

    #: Number of each term, and the rows of ``item_of`` that are its items.
    terms: dict[str, int]
    starts: np.ndarray
    item_of: np.ndarray
    #: The same for the bundles of a term's items.
    bundle_starts: np.ndarray
    bundle_of: np.ndarray
    weight: np.ndarray
    owner: np.ndarray
    #: Most that an item can still gain after each owner: (owner, item).
    to_come: np.ndarray
    items: int
    #: Items of a bundle, documents of a bucket.
    bundle: int
    bucket: int


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share in a document, before its weight."""
    return SCALE**3 * tf // (SCALE * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return floor(SCALE * log((2 * documents + 2) / (2 * df + 1)))


def _plan(entries: list, documents: int) -> Plan:
    """A block's plan from (item number, term, df, most impact)."""
    known = {term: (df, most) for _, term, df, most in entries}
    # Rarest first; terms of one document frequency in order of themselves.
    ordered = sorted(known, key=lambda term: (known[term][0], term))
    number = {term: at for at, term in enumerate(ordered)}
    weights = np.array([weight(documents, known[term][0]) for term in ordered], np.int64)
    most = np.array([known[term][1] for term in ordered], np.int64)
    # Equal shares of the documents' postings would leave one owner all rare
    # terms; each owner has twice the document frequencies of the one before.
    shares = np.cumsum([known[term][0] for term in ordered]) / max(
        1, sum(df for df, _ in known.values())
    )
    bounds = (2.0 ** np.arange(1, OWNERS) - 1) / (2**OWNERS - 1)
    owner = np.searchsorted(bounds, shares, "left")
    pairs = np.array(sorted((number[term], item) for item, term, _, _ in entries), np.int64)
    items = 1 + int(pairs[:, 1].max())
    to_come = np.zeros((OWNERS, items), np.int64)
    for at in range(OWNERS):
        later = owner[pairs[:, 0]] > at
        np.add.at(to_come[at], pairs[later, 1], (weights * most)[pairs[later, 0]])
    starts = np.searchsorted(pairs[:, 0], np.arange(len(ordered) + 1))
    bundled = np.unique(np.stack([pairs[:, 0], pairs[:, 1] // BUNDLE], 1), axis=0)
    bundle_starts = np.searchsorted(bundled[:, 0], np.arange(len(ordered) + 1))
    return Plan(
        number,
        starts,
        pairs[:, 1],
        bundle_starts,
        bundled[:, 1],
        weights,
        owner,
        to_come,
        items,
        BUNDLE,
        BUCKET,
    )


def _cogrouped(left: DataFrame, right: DataFrame, function, schema) -> DataFrame:
    keys = ("bundle", "bucket")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, schema)


#: A bundle of accumulators: for each, item and place in the bucket, as one
#: number, and its score.
STATE = "bundle int, bucket long, cells binary, scores binary"


def _postings(counts: DataFrame, plan, owner: int, documents: int, length: int) -> DataFrame:
    """(bundle, bucket, term, places, shares, ids): where an owner's terms are, and how much.

    A row is a term in some documents of a bucket, and goes to every bundle
    with an item of the term. For the last owner rows of term -1 have the ids
    of the documents that hold any term of a bundle.
    """
    ids = T.ArrayType(counts.schema["id"].dataType)
    schema = T.StructType(
        [
            T.StructField("bundle", T.IntegerType()),
            T.StructField("bucket", T.LongType()),
            T.StructField("term", T.IntegerType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("shares", T.BinaryType()),
            T.StructField("ids", ids),
        ]
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plan.value
        for batch in slices(batches, known.bucket):
            sizes = batch.column(3).value_lengths().to_numpy()
            names = batch.column(3).flatten().to_pylist()
            term = np.fromiter((known.terms.get(name, -1) for name in names), np.int64, len(names))
            tf = batch.column(4).flatten().to_numpy()
            at = np.repeat(np.arange(batch.num_rows), sizes)
            row, n = batch.column(0).to_numpy()[at], batch.column(2).to_numpy()[at]
            held = term >= 0
            own = held & (known.owner[term] == owner)
            rows = _grouped(known, term[own], row[own], tf[own], n[own], documents, length)
            none = batch.column(1).slice(0, 0)
            found_ids = [none] * len(rows)
            if owner == OWNERS - 1:
                for bundle, bucket, of in _documents(known, term[held], at[held], row[held]):
                    places = (batch.column(0).to_numpy()[of] % known.bucket).astype("<i4").tobytes()
                    rows.append((bundle, bucket, -1, places, b""))
                    found_ids.append(batch.column(1).take(pa.array(of)))
            offsets = np.cumsum([0, *map(len, found_ids)], dtype=np.int32)
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(column, kind) for column, kind in zip(columns, kinds)],
                    pa.ListArray.from_arrays(offsets, pa.concat_arrays([none, *found_ids])),
                ],
                names=schema.names,
            )

    return counts.select("row", "id", "n", "terms", "tfs").mapInArrow(gather, schema)


def _grouped(
    known: Plan,
    term: np.ndarray,
    row: np.ndarray,
    tf: np.ndarray,
    n: np.ndarray,
    documents: int,
    length: int,
) -> list[tuple]:
    """Occurrences as rows of (bundle, bucket, term, places, shares)."""
    # A length times the documents may pass 64 bits: Python's own numbers.
    by_n = {
        one: 100 - LENGTH_SHARE + LENGTH_SHARE * one * documents // length
        for one in np.unique(n).tolist()
    }
    share = impact(tf, np.fromiter(map(by_n.__getitem__, n.tolist()), np.int64, len(n)))
    order = np.lexsort((row, term, row // known.bucket))
    term, row, share = term[order], row[order], share[order]
    bucket = row // known.bucket
    new = (np.diff(term, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0)
    first = np.flatnonzero(new).tolist()
    rows = []
    for start, stop in zip(first, [*first[1:], len(term)]):
        one = int(term[start])
        places = (row[start:stop] % known.bucket).astype("<i4").tobytes()
        shares = share[start:stop].astype("<i4").tobytes()
        for bundle in known.bundle_of[known.bundle_starts[one] : known.bundle_starts[one + 1]]:
            rows.append((int(bundle), int(bucket[start]), one, places, shares))
    return rows


def _documents(
    known: Plan, term: np.ndarray, at: np.ndarray, row: np.ndarray
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bundle, bucket, places in the slice): the documents with any term of a bundle."""
    starts, counts = known.bundle_starts[term], np.diff(known.bundle_starts)[term]
    ends = np.cumsum(counts)
    bundle = known.bundle_of[
        np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
    ]
    held = np.unique(
        np.stack([bundle, np.repeat(row // known.bucket, counts), np.repeat(at, counts)], 1), axis=0
    )
    cuts = np.flatnonzero(np.any(np.diff(held[:, :2], axis=0) != 0, axis=1)) + 1
    for part in np.split(held, cuts):
        if len(part):
            yield int(part[0, 0]), int(part[0, 1]), part[:, 2]


def _gathered(known: Plan, bundle: int, state: pa.Table, postings: pa.Table) -> np.ndarray:
    """A bundle's scores over its bucket, (item, place), with an owner's postings added."""
    first = bundle * known.bundle
    items = min(known.bundle, known.items - first)
    scores = np.zeros((items, known.bucket), np.int64)
    for cells, held in zip(state.column("cells"), state.column("scores")):
        cells = np.frombuffer(cells.as_py(), "<i4")
        scores.ravel()[cells] = np.frombuffer(held.as_py(), "<i8")
    for term, places, shares in zip(
        *(postings.column(name).to_pylist() for name in ("term", "places", "shares"))
    ):
        if term >= 0:
            of = known.item_of[known.starts[term] : known.starts[term + 1]] - first
            of = of[(of >= 0) & (of < items)]
            gains = known.weight[term] * np.frombuffer(shares, "<i4")
            scores[of[:, None], np.frombuffer(places, "<i4")] += gains
    return scores


def _added(plan, least, owner: int):
    """A cogroup's function: an owner's postings added to a bundle's accumulators."""

    def add(key, state: pa.Table, postings: pa.Table) -> pa.Table:
        known = plan.value
        bundle, bucket = (part.as_py() for part in key)
        scores = _gathered(known, bundle, state, postings)
        of = slice(bundle * known.bundle, bundle * known.bundle + len(scores))
        open_ = (scores > 0) & (scores + known.to_come[owner, of, None] >= least.value[of, None])
        cells = np.flatnonzero(open_.ravel()).astype("<i4")
        rows = 1 if len(cells) else 0
        return pa.table(
            {
                "bundle": pa.array([bundle][:rows], pa.int32()),
                "bucket": pa.array([bucket][:rows], pa.int64()),
                "cells": pa.array([cells.tobytes()][:rows], pa.binary()),
                "scores": pa.array([scores.ravel()[cells].tobytes()][:rows], pa.binary()),
            }
        )

    return add


def _selected(plan, least, top: int):
    """A cogroup's function: the last postings added, and each item's best documents."""

    def select(key, state: pa.Table, postings: pa.Table) -> pa.Table:
        known = plan.value
        bundle = key[0].as_py()
        scores = _gathered(known, bundle, state, postings)
        first = bundle * known.bundle
        bounds = least.value[first : first + len(scores), None]
        item, place = np.nonzero((scores > 0) & (scores >= bounds))
        held = postings.filter(pc.equal(postings.column("term"), -1))
        ids = pc.list_flatten(held.column("ids"))
        at = np.zeros(known.bucket, np.int64)
        places = [np.frombuffer(one, "<i4") for one in held.column("places").to_pylist()]
        if places:
            at[np.concatenate(places)] = np.arange(len(ids))
        found = pa.table(
            {
                "number": pa.array((item + first).astype(np.int32)),
                "id": ids.take(pa.array(at[place])),
                "score": pa.array(scores[item, place]),
            }
        )
        order = pc.sort_indices(
            found,
            sort_keys=[("number", "ascending"), ("score", "descending"), ("id", "ascending")],
            null_placement="at_start",
        )
        found = found.take(order)
        number = found.column("number").to_numpy()
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        return found.filter(pa.array(rank < top))

    return select


def _bounds(state: DataFrame, plan, top: int) -> np.ndarray:
    """The least of each item's ``top`` best scores so far, 1 if it has fewer."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plan.value
        held = np.zeros((known.items, top), np.int64)
        for batch in slices(batches, 16):
            for bundle, cells, scores in zip(*(batch.column(n).to_pylist() for n in (0, 2, 3))):
                cells, scores = np.frombuffer(cells, "<i4"), np.frombuffer(scores, "<i8")
                of = cells // known.bucket
                starts = np.searchsorted(of, np.arange(of[-1] + 2))
                for item in np.unique(of).tolist():
                    part = scores[starts[item] : starts[item + 1]]
                    if len(part) > top:
                        part = np.partition(part, -top)[-top:]
                    at = bundle * known.bundle + item
                    held[at] = np.sort(np.concatenate([held[at], part]))[-top:]
        item, place = np.nonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(held[item, place])], names=["item", "score"]
        )

    scores = state.mapInArrow(best, "item int, score long")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"))
    bounds = np.ones(plan.value.items, np.int64)
    for item, score in (
        scores.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") == top)
        .select("item", "score")
        .collect()
    ):
        bounds[item] = score
    return bounds


def _search(counts: DataFrame, entries: list, documents: int, length: int, top: int) -> DataFrame:
    """(number, id, score): a block's candidates, at least the ``top`` best of each item."""
    spark = counts.sparkSession
    made = _plan(entries, documents)
    plan = spark.sparkContext.broadcast(made)
    bounds = np.ones(made.items, np.int64)
    state = spark.createDataFrame([], STATE)
    for owner in range(OWNERS - 1):
        least = spark.sparkContext.broadcast(bounds)
        postings = _postings(counts, plan, owner, documents, length)
        state = written(_cogrouped(state, postings, _added(plan, least, owner), STATE), "bundles")
        bounds = np.maximum(bounds, _bounds(state, plan, top))
    schema = T.StructType(
        [
            T.StructField("number", T.IntegerType()),
            T.StructField("id", counts.schema["id"].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    least = spark.sparkContext.broadcast(bounds)
    last = _postings(counts, plan, OWNERS - 1, documents, length)
    return _cogrouped(state, last, _selected(plan, least, top), schema)


def _known_terms(
    counts: DataFrame, terms: DataFrame, documents: int, length: int
) -> DataFrame:
    """(item, term, df, most): the item terms that documents hold, written.

    ``most`` is the greatest share that the term has in a document.
    """
    # m as a decimal on the way: a length times the documents may pass 64 bits.
    m = F.expr(
        f"{100 - LENGTH_SHARE} + (cast({LENGTH_SHARE * documents} as decimal(30,0)) * n)"
        f" div {max(length, 1)}"
    )
    held = counts.withColumn("m", m).select(
        "m", F.inline(F.arrays_zip(F.col("terms").alias("of"), F.col("tfs").alias("tf")))
    )
    share = F.expr(f"({SCALE**3}L * tf) div ({SCALE} * tf + 8 * m)")
    of_terms = held.groupBy("of").agg(F.count("*").alias("df"), F.max(share).alias("most"))
    joined = terms.join(of_terms, terms["term"] == F.col("of"))
    return written(joined.select("item", "term", "df", "most"), "known-terms")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(item, rank, id, score): each item's ``top`` documents of highest score above 0."""
    terms = item_terms(items, item_column, item_text_column)
    counts = term_counts(docs, terms, id_column, text_column)
    documents, length = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    known = _known_terms(counts, terms, documents, length or 0)
    blocks = -(-known.count() // BLOCK)
    spark, found = docs.sparkSession, []
    for block in range(blocks):
        of_block = F.pmod(F.xxhash64("item"), F.lit(blocks)) == block
        rows = known.where(of_block).collect()
        numbers = {item: at for at, item in enumerate(dict.fromkeys(row.item for row in rows))}
        entries = [(numbers[row.item], row.term, row.df, row.most) for row in rows]
        if entries:
            names = spark.createDataFrame(
                [(at, item) for item, at in numbers.items()],
                T.StructType([T.StructField("of", T.IntegerType()), known.schema["item"]]),
            )
            best = _search(counts, entries, documents, length, top)
            found.append(best.join(names, F.col("number") == F.col("of")))
    if not found:
        return known.select(
            "item", F.lit(0).alias("rank"), F.lit(None).cast(docs.schema[id_column].dataType)
            .alias("id"), F.lit(0).cast("long").alias("score")
        ).limit(0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))
    return (
        reduce(DataFrame.union, found)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("item", "rank", "id", "score")
    )
