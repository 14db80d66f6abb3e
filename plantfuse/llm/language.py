"""Language of documents: the family first, then the language within it.

A text's features are its counts of hashed trigrams of lower-case code points,
as square roots, scaled to length one: whole texts, however long. Linear support
vector machines, one for each pair of classes, vote on the language family;
then those of the family's pairs of languages vote on the language. Ties go to
the class with the greater sum of margins, then to the first by name. A vote's
confidence is the least of the winner's, each 1 / (1 + exp(-2 margin)); the
score is the lesser of the two votes'.

Every label is learned. The machines are fitted on the driver on a sample that
is bounded by parameters: of each language at most ``PER_LANGUAGE`` different
labelled documents, those of least hash of id and text, or fewer if there are so
many languages that the sample would have over ``SAMPLE`` documents, but
``LEAST`` if there are as many. Copies of one id and text are one document of the
sample. There is a machine for each pair of families, whatever their number.
Labels, sources and ids are no features. Everything else covers all documents.

A text that is NULL or has no letter is ``und`` with score 0, and so are all if
no row has a label. A language without relatives is a family of its own.
NULL ids and texts are the empty text to the hash. Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import slices

FEATURES = 2048
PER_LANGUAGE = 1000
#: Documents of the sample, and documents of a language that are always learned from.
SAMPLE, LEAST = 50_000, 50
UNKNOWN = "und"

# Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nb nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "austronesian": "id jv mg ms su tl",
    "dravidian": "kn ml ta te",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

has_letter = regex.compile(r"\p{L}").search


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return FAMILY_OF.get(code, language)


def features(text: str | None) -> np.ndarray:
    """A text's vector of length one, or zero if it is too short for a trigram."""
    line = f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(line, np.uint32)
    # Odd multipliers; the upper bits of the sum choose the feature.
    mixed = codes[:-2] * np.uint32(0x9E3779B1)
    mixed += codes[1:-1] * np.uint32(0x85EBCA77)
    mixed += codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    vector = np.sqrt(counts)
    length = np.sqrt(counts.sum())
    return (vector / length if length else vector).astype(np.float32)


def fit_machine(rows: np.ndarray, positive: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Weights, the bias last, of a linear support vector machine.

    Dual coordinate descent for the squared hinge loss, with classes weighted
    alike however many rows they have.
    """
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)]).astype(np.float64)
    sign = np.where(positive, 1.0, -1.0)
    share = np.where(positive, positive.mean(), 1 - positive.mean())
    slack = share  # 1 / (2 C), C inverse to the class's share
    norms = (rows**2).sum(1) + slack
    weights, alpha = np.zeros(rows.shape[1]), np.zeros(len(rows))
    order = np.random.default_rng(len(rows))
    for _ in range(rounds):
        for at in order.permutation(len(rows)):
            gradient = sign[at] * (rows[at] @ weights) - 1 + slack[at] * alpha[at]
            new = max(0.0, alpha[at] - gradient / norms[at])
            if new != alpha[at]:
                weights += (new - alpha[at]) * sign[at] * rows[at]
                alpha[at] = new
    return weights


@dataclass
class Vote:
    """One-versus-one machines over some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray) -> Vote:
        classes = sorted(set(labels.tolist()))
        pairs = list(combinations(range(len(classes)), 2))
        weights = np.zeros((len(pairs), FEATURES + 1))
        for number, (one, other) in enumerate(pairs):
            mine = np.isin(labels, [classes[one], classes[other]])
            weights[number] = fit_machine(rows[mine], labels[mine] == classes[one])
        return cls(classes, pairs, weights)

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's class and its confidence."""
        margins = rows @ self.weights[:, :-1].T + self.weights[:, -1]
        count = len(self.classes)
        votes, total = np.zeros((len(rows), count)), np.zeros((len(rows), count))
        confidence = np.ones((len(rows), count))
        for margin, (one, other) in zip(margins.T, self.pairs):
            votes[:, one] += margin >= 0
            votes[:, other] += margin < 0
            for place, own in ((one, margin), (other, -margin)):
                total[:, place] += own
                sure = 1 / (1 + np.exp(-2 * np.clip(own, -300, 300)))
                confidence[:, place] = np.minimum(confidence[:, place], sure)
        best = np.where(votes == votes.max(1, keepdims=True), total, -np.inf).argmax(1)
        return best, confidence[np.arange(len(rows)), best]


@dataclass
class Model:
    """The vote on families and, for each family, the vote on its languages."""

    families: Vote
    languages: dict[str, Vote]

    @classmethod
    def fit(cls, rows: np.ndarray, labels: Sequence[str]) -> Model:
        named = np.array(labels, object)
        families = np.array([family_of(label) for label in labels], object)
        return cls(
            Vote.fit(rows, families),
            {
                family: Vote.fit(rows[families == family], named[families == family])
                for family in set(families.tolist())
            },
        )

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = np.array([n for n, text in enumerate(texts) if text and has_letter(text)], int)
        if not len(known):
            return names, scores
        rows = np.array([features(texts[n]) for n in known])
        family, sure = self.families(rows)
        for number, name in enumerate(self.families.classes):
            mine = np.flatnonzero(family == number)
            if not len(mine):
                continue
            vote = self.languages[name]
            language, surer = vote(rows[mine])
            for at, best, score in zip(mine, language, np.minimum(sure[mine], surer)):
                names[known[at]] = vote.classes[best]
                scores[known[at]] = float(score)
        return names, scores


def fit(
    docs: DataFrame,
    usable: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    per_language: int = PER_LANGUAGE,
    languages: int | None = None,
) -> Model | None:
    """A model of the labelled rows for which ``usable`` holds; None without any.

    ``languages``: so many of the most frequent labels only, not all.
    """
    text_id = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = docs.where(usable).select(
        F.col(label_column).cast("string").alias("label"),
        F.col(text_column).alias("text"),
        F.xxhash64(text_id, F.col(text_column)).alias("hash"),
    )
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("label").agg(
        F.count("*").alias("count"), F.approx_count_distinct("hash").alias("different")
    )
    if languages is not None:
        counts = counts.orderBy(F.desc("count"), "label").limit(languages)
    counts = counts.collect()
    if not counts:
        return None
    most = min(per_language, max(LEAST, SAMPLE // len(counts)))
    # The number is known to a few percent: enough are drawn, and those over ``most`` cut off.
    drawn = 1.3 * most + 100
    share = docs.sparkSession.createDataFrame(
        [(row.label, min(1.0, drawn / max(1, row.different))) for row in counts],
        "label string, share double",
    )
    # Uniform in 0..1 and the same on every run.
    place = F.col("hash") / 2.0**64 + 0.5
    chosen = (
        rows.join(F.broadcast(share), "label")
        .where(place <= F.col("share"))
        .groupBy("label", "hash")
        .agg(F.min("text").alias("text"))
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(text).tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.binary())],
                names=["label", "hash", "vector"],
            )

    order = Window.partitionBy("label").orderBy("hash")
    least = chosen.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    sample = (
        least.select("label", "hash", "text")
        .mapInArrow(vectors, "label string, hash long, vector binary")
        .collect()
    )
    sample.sort(key=lambda row: (row.label, row.hash))
    vectors_of = np.array([np.frombuffer(row.vector, np.float32) for row in sample])
    return Model.fit(vectors_of.reshape(len(sample), FEATURES), [row.label for row in sample])


def predicted(
    docs: DataFrame, model: Model | None, text_column: str = "text", result: str = "language"
) -> DataFrame:
    """The rows with a struct column: lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(
        T.StructType(
            [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        )
    )
    def predict(texts: pa.Array) -> pa.Array:
        names: list[str] = []
        scores: list[float] = []
        for start in range(0, len(texts), 256):
            part = texts[start : start + 256].to_pylist()
            none = [UNKNOWN] * len(part), [0.0] * len(part)
            found = sent.value.predict(part) if sent.value else none
            names += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=["lang_pred", "score"],
        )

    return docs.withColumn(result, predict(text_column))
