"""Operators as filters and rewrites of a table of documents.

Each takes documents (``doc_id``, ``text``, ``lang``, ``n_chars`` and any other
columns) and returns the same columns of those that stay. Rows of one id, the
NULL one too, are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantfuse.llm import bpe, decontaminate, language, line_dedup, near_copies


def _columns(docs: DataFrame) -> list[Column]:
    return [docs[f"`{name}`"] for name in docs.columns]


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join with a column of ids that may be NULL."""
    ids = ids.toDF("stage_id")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["stage_id"]), how)


def known_language(docs: DataFrame) -> DataFrame:
    """Documents for which a language is predicted; those without a letter have none.

    A low score rejects nothing: texts in two of the languages have one too.
    With no label in the table all documents with letters stay.
    """
    model = language.fit(docs, F.lit(True))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predicted(docs, model, result="stage_language")
    return found.where(F.col("stage_language.lang_pred") != language.UNKNOWN).select(
        *_columns(docs)
    )


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that others keep; ``n_chars`` is of what is left."""
    found = line_dedup.without_shared_lines(docs, result="stage_lines")
    kept = F.col("stage_lines.kept")
    changed = {"text": kept, "n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)}
    return found.select(
        *[
            F.when(F.col("stage_lines.n_dropped") > 0, changed[name])
            .otherwise(docs[name])
            .alias(name)
            if name in changed
            else docs[f"`{name}`"]
            for name in docs.columns
        ]
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates the document of least id.

    Duplicates are documents whose shingles of five words have a Jaccard index
    of 0.8 or more: found by the SimHashes of sampled shingles, and the rest of
    them by prefixes of rare shingles.
    """
    found = near_copies.near_copies(docs)
    first = found.where(F.col("id").eqNullSafe(F.col("component"))).select("id").distinct()
    return _with_ids(docs, first, "left_semi")


def without_benchmarks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark item is found, with up to a fifth of its words edited."""
    found = decontaminate.contaminated(docs, benchmark)
    return _with_ids(docs, found.select("doc_id").distinct(), "left_anti")


def tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, the token ids, their number, and whether they decode to the text."""
    texts = docs.select(F.struct("doc_id", "text").alias("doc"), F.col("text").alias("whole"))
    coded = bpe.round_trip(texts, ranks_path, pattern, "doc", "whole")
    text = F.coalesce("id.text", F.lit(""))
    return coded.select(
        F.col("id.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == text.cast("binary")).alias("decodes"),
    )
