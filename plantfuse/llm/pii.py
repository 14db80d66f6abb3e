"""Spans of personal data: base rules, and weak labelers aggregated into a classifier.

Base kinds are found by their rules alone: email, ip, card and phone. Two more
kinds, names and secrets, have no rule that is right by itself:

1. A wide pattern proposes candidate spans. Labelers look at the candidate's
   shape (regex), its words (gazetteers) and what stands around it (context);
   each votes for, against, or not at all.
2. Expectation-maximisation estimates how often each labeler votes either way on
   true and on false candidates, without any labels, from the counts of the
   patterns of votes over all documents.
3. A logistic classifier of votes and shape is fitted to the resulting
   probabilities and decides every candidate. It may keep what few labelers
   knew, and drop what a reliable one rejects.

What reaches the driver is one row for each pattern of votes and shape, of which
there are a bounded number (``PATTERNS``); counting them covers all documents.
Only DataFrame functions run. Starts and ends are code points, ends exclusive.
Matches are leftmost and do not overlap within their kind; those that fail their
kind's check are dropped and not tried again. A NULL text counts as empty and
has no spans. Rows are independent; other columns play no part.

Patterns loop over single characters only, which Java's engine does without
recursion, and begin at the start of a run, so that texts of any length take
linear time: dots and blanks that may stand inside a match are first replaced by
a mark of the same length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Noncharacters: they begin and end a match, and stand for an inner separator.
BEGIN, END, INNER = "﷐", "﷑", "﷒"
MARKS = BEGIN + END + INNER

#: Code points of context that labelers see before and after a candidate.
BEFORE, AFTER = 24, 16
#: Matches whose starts are added up together.
BLOCK = 128
BASE = ("email", "ip", "card", "phone")

# First names that are frequent in several languages.
FIRST_NAMES = (
    "Adam Alexander Alice Ana Andreas Anna Antonio Barbara Carlos Carmen Charles Christian Claire "
    "Daniel David Elena Elizabeth Emma Eva Francisco Hans Isabel James Jan Jean Jennifer John Jorge "
    "Jose Juan Julia Karl Klaus Laura Linda Lucas Luis Manuel Marc Maria Marie Mark Martin Mary "
    "Michael Miguel Nicolas Olivia Patricia Paul Pedro Peter Philippe Pierre Robert Sarah Sofia "
    "Sophie Stefan Susan Thomas William Wolfgang"
)
# Words that begin sentences and not names.
STARTERS = (
    "A An And As At But By For From He Her His I If In It Its My No Not Of On Or Our She So That "
    "The Their There These They This To We What When Where Who With You Der Die Das Ein Eine Es Ich "
    "Und Wir El La Las Los Un Una Y De En Le Les Une Des Et Il Elle Je Nous"
)
# What stands before names, and after them.
TITLES = (
    r"(?i)(?<!\p{L})(mr|mrs|ms|dr|prof|herr|frau|señor|señora|monsieur|madame|name is|named|contact"
    r"|regards,?|sincerely,?|signed|by)[.:]?\s+$"
)
DEEDS = r"(?i)^\s*(,\s*(born|aged?|phd)\b|said\b|wrote\b|lives\b|was born\b|works\b|<|\()"
# How well-known secrets begin, and words that announce one or something else.
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live|pk_live|xox[abps]-|AIza|eyJ|glpat-)"
SECRET_WORDS = r"(?i)(token|secret|api|key|password|passwd|pwd|auth|bearer|credential)[^A-Za-z0-9]*$"
OTHER_WORDS = r"(?i)(sha\d*|md5|checksum|digest|commit|hash|uuid|isbn|http|https|www|file|id)[^A-Za-z0-9]*$"


def prepared(text: Column) -> Column:
    """The text without marks, NULL as empty; every code point stays one."""
    return F.translate(F.coalesce(text, F.lit("")), MARKS, "�" * len(MARKS))


def _running(lengths: Column) -> Column:
    """For each length the sum of those before it.

    Block by block: an array that grows by one is copied each time.
    """
    empty = F.array().cast("array<int>")

    def sums(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("sum"), empty.alias("out")),
            lambda acc, n: F.struct(
                (acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")
            ),
        )

    count = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")),
        lambda number: F.slice(lengths, number * BLOCK + 1, F.lit(BLOCK)),
    )
    return F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("out")),
        lambda acc, block: F.struct(
            sums(block, acc["sum"])["sum"].alias("sum"),
            F.concat(acc["out"], F.array(sums(block, acc["sum"])["out"])).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )


@dataclass(frozen=True)
class Rule:
    """How a kind's matches are found: the pattern, run on the text with inner separators marked."""

    kind: str
    hint: str
    pattern: str
    inner: str = ""
    holds: Callable[[Column], Column] = lambda match: F.lit(True)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(place: Column) -> Column:
        digit = F.substr(digits, place, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(place % 2 == 1, digit).otherwise(
            F.when(double > 9, double - 9).otherwise(double)
        )

    total = F.aggregate(places, F.lit(0), lambda sum_, place: sum_ + worth(place))
    return F.length(digits).between(16, 19) & (total % 10 == 0)


LOCAL = f"A-Za-z0-9._%+{INNER}-"
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
RULES = (
    Rule(
        "email",
        "@",
        rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{INNER}[A-Za-z0-9{INNER}-]++",
        inner=r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
    ),
    Rule(
        "ip",
        ".",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        holds=lambda match: match.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    ),
    Rule(
        "card",
        "",
        f"[0-9][0-9{INNER}]++",
        inner=r"(?<=[0-9])[\x20-](?=[0-9])",
        holds=lambda match: F.length(_digits(match)).between(16, 19) & _luhn(match),
    ),
    Rule(
        "phone",
        "+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        holds=lambda match: F.length(_digits(match)).between(8, 15),
    ),
)
CANDIDATES = (
    Rule(
        "name",
        "",
        r"(?<!\p{L})\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?(?!\p{L})",
    ),
    Rule(
        "secret",
        "",
        r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
        holds=lambda match: match.rlike("[0-9]") & match.rlike("[A-Za-z]"),
    ),
)


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")


def _pieces(rule: Rule) -> Column:
    """Of ``line``: (match, gap) structs, the gap being what follows; the first has no match."""
    line = F.col("line")
    if rule.inner:
        line = F.regexp_replace(line, rule.inner, INNER)
    marked = F.regexp_replace(line, rule.pattern, f"{BEGIN}$0{END}")
    pieces = F.transform(
        F.split(marked, BEGIN),
        lambda piece: F.struct(
            F.when(F.contains(piece, F.lit(END)), F.substring_index(piece, END, 1))
            .otherwise("")
            .alias("match"),
            F.substring_index(piece, END, -1).alias("gap"),
        ),
    )
    return F.when(F.contains(F.col("line"), F.lit(rule.hint)), pieces)


def found(docs: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """The kept columns and, for each rule, an array named by its kind.

    Elements: start, end, match, and the context before and after it. ``docs``
    has the prepared text as ``line``.
    """
    kinds = [rule.kind for rule in rules]
    pieces = docs.select(*keep, *[_pieces(rule).alias(rule.kind) for rule in rules])
    sizes = pieces.select(
        *keep,
        *kinds,
        *[
            F.transform(kind, lambda piece: F.length(piece["match"]) + F.length(piece["gap"])).alias(
                f"{kind}_sizes"
            )
            for kind in kinds
        ],
    )
    starts = sizes.select(
        *keep,
        *kinds,
        *[
            F.when(F.size(kind) > 1, _running(F.col(f"{kind}_sizes"))).alias(f"{kind}_starts")
            for kind in kinds
        ],
    )

    def spans(rule: Rule) -> Column:
        pieces, starts = F.col(rule.kind), F.col(f"{rule.kind}_starts")
        before = F.transform(
            F.slice(pieces, 1, F.size(pieces) - 1), lambda piece: F.right(piece["gap"], F.lit(BEFORE))
        )
        all_ = F.arrays_zip(
            F.slice(pieces, 2, F.size(pieces) - 1).alias("piece"),
            F.slice(starts, 2, F.size(pieces) - 1).alias("start"),
            before.alias("before"),
        )
        placed = F.transform(
            all_,
            lambda at: F.struct(
                at["start"].alias("start"),
                (at["start"] + F.length(at["piece"]["match"])).alias("end"),
                at["piece"]["match"].alias("match"),
                at["before"].alias("before"),
                F.left(at["piece"]["gap"], F.lit(AFTER)).alias("after"),
            ),
        )
        held = F.filter(placed, lambda span: rule.holds(span["match"]))
        return F.when(F.size(pieces) > 1, held).otherwise(_no_spans())

    return starts.select(*keep, *[spans(rule).alias(rule.kind) for rule in rules])


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 1).when(against, -1).otherwise(0)


def _in_list(words: str, word: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, words.split())), word)


def name_votes(span: Column) -> list[Column]:
    match, before, after = span["match"], span["before"], span["after"]
    words = F.split(match, " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return [
        # Shape: a name repeats no word and has words of common lengths.
        _vote(F.lit(False), (first == second) | (F.length(first) > 14) | (F.length(second) > 16)),
        _vote(_in_list(FIRST_NAMES, first), _in_list(STARTERS, first)),
        _vote(F.lit(False), _in_list(STARTERS, second)),
        _vote(before.rlike(TITLES), before.rlike(r"(^|[.!?|#\n]\s*)$")),
        _vote(after.rlike(DEEDS), after.rlike(r"^\s?\p{Lu}\p{Ll}")),
    ]


def secret_votes(span: Column) -> list[Column]:
    match, before, after = span["match"], span["before"], span["after"]
    hexadecimal = match.rlike("^[0-9a-f]+$") | match.rlike("^[0-9A-F]+$")
    mixed = match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return [
        _vote(hexadecimal & F.length(match).isin(32, 40, 48, 56, 64, 128) | mixed, match.rlike("[0-9]{12}")),
        _vote(match.rlike(PREFIXES), F.lit(False)),
        _vote(before.rlike(SECRET_WORDS), before.rlike(OTHER_WORDS)),
        _vote(before.rlike("[=:]\\s?[\"']?$"), before.rlike("[/.#?&]$")),
        _vote(before.rlike("[\"']$") & after.rlike("^[\"']"), after.rlike("^[/.@]")),
    ]


VOTES: dict[str, Callable[[Column], list[Column]]] = {"name": name_votes, "secret": secret_votes}
LABELERS = 5


def shape(span: Column) -> list[Column]:
    """Small numbers that describe a candidate: its length, its digits, its capitals."""
    match = span["match"]
    size = F.length(match)
    share = lambda pattern: F.round(3 * F.length(F.regexp_replace(match, pattern, "")) / size).cast("int")
    return [F.least(F.floor(F.log2(size)).cast("int"), F.lit(9)), share("[^0-9]"), share(r"[^\p{Lu}]")]


#: Patterns of votes and shapes of a kind, at most: 3 votes; 10 lengths, 4 shares twice.
PATTERNS = 3**LABELERS * 10 * 4 * 4


def patterns(docs: DataFrame) -> DataFrame:
    """kind, votes, shape and n: how often each pattern occurs over all documents."""
    spans = found(docs.select("line"), CANDIDATES, [])
    counted = None
    for rule in CANDIDATES:
        span = F.col("span")
        # The outer form: for the other one Spark would first evaluate the array's
        # expressions once more, to drop rows without candidates.
        exploded = spans.select(F.explode_outer(rule.kind).alias("span"))
        part = exploded.where("span IS NOT NULL").select(
            F.lit(rule.kind).alias("kind"),
            F.array(*VOTES[rule.kind](span)).alias("votes"),
            F.array(*shape(span)).alias("shape"),
        )
        counted = part if counted is None else counted.unionAll(part)
    return counted.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n"))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(chances, truth): each labeler's chance of each vote on false and true
    candidates, and each pattern's probability of being true.

    Labelers are assumed independent given the truth. No vote for may speak
    against, nor the other way round: where the estimates say so, the two
    classes share them. What nobody votes for is false. Without that, and some
    imagined votes of labelers that are right more often than wrong, any two
    kinds of false candidates could pass for the two classes.
    """
    imagined = np.array([[4.0, 8.0, 1.0], [1.0, 8.0, 4.0]])  # false, true; votes -1, 0, 1
    voted_for = (votes == 1).any(1)
    truth = voted_for / (1 + np.exp(1 - 2.0 * votes.sum(1)))
    chances = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        prior = np.array([(counts * (1 - truth)).sum() + 1, (counts * truth).sum() + 1])
        prior[1] = min(prior[1], prior[0])
        for true, weight in enumerate((counts * (1 - truth), counts * truth)):
            for labeler in range(votes.shape[1]):
                seen = np.bincount(votes[:, labeler] + 1, weights=weight, minlength=3)
                seen = seen + imagined[true]
                chances[true, labeler] = seen / seen.sum()
        for vote, sign in ((2, 1), (0, -1)):
            wrong = sign * chances[1, :, vote] < sign * chances[0, :, vote]
            shared = (prior @ chances[:, :, vote]) / prior.sum()
            chances[:, wrong, vote] = shared[wrong]
        chances[:, :, 1] = 1 - chances[:, :, 0] - chances[:, :, 2]
        log = np.log(prior / prior.sum()) + np.stack(
            [
                sum(np.log(chances[true, labeler, votes[:, labeler] + 1]) for labeler in range(votes.shape[1]))
                for true in (0, 1)
            ],
            axis=1,
        )
        truth = voted_for / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return chances, truth


def _inputs(votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    return np.hstack([votes == 1, votes == -1, shapes, np.ones((len(votes), 1))]).astype(float)


def fit_classifier(inputs: np.ndarray, truth: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic weights for probable labels, by Newton's method with a small ridge."""
    weights = np.zeros(inputs.shape[1])
    share = counts / counts.sum()
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (share * (chance - truth)) + 1e-4 * weights
        bend = (inputs * (share * chance * (1 - chance))[:, None]).T @ inputs
        step = np.linalg.solve(bend + 1e-4 * np.eye(len(weights)), slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass
class Labeled:
    """What was learned about one kind: its labelers' chances and its classifier."""

    chances: np.ndarray
    weights: np.ndarray


def learned(docs: DataFrame) -> dict[str, Labeled]:
    """For each kind that has candidates, its labelers and classifier."""
    rows = patterns(docs).collect()
    rows.sort(key=lambda row: (row.kind, row.votes, row.shape))
    kinds = {}
    for kind in VOTES:
        mine = [row for row in rows if row.kind == kind]
        if not mine:
            continue
        votes = np.array([row.votes for row in mine])
        counts = np.array([row.n for row in mine], float)
        chances, truth = reliabilities(votes, counts)
        inputs = _inputs(votes, np.array([row.shape for row in mine]))
        kinds[kind] = Labeled(chances, fit_classifier(inputs, truth, counts))
    return kinds


def _is_true(kind: str, weights: np.ndarray, span: Column) -> Column:
    votes = VOTES[kind](span)
    inputs = [F.when(vote == 1, 1.0).otherwise(0.0) for vote in votes]
    inputs += [F.when(vote == -1, 1.0).otherwise(0.0) for vote in votes]
    inputs += [*shape(span), F.lit(1.0)]
    total = F.lit(0.0)
    for value, weight in zip(inputs, weights.tolist(), strict=True):
        if not math.isclose(weight, 0, abs_tol=1e-12):
            total += value * weight
    return total > 0


def personal_data(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id and, for each kind, the array of its spans: start, end, match, context."""
    lines = docs.select(
        F.col(id_column).alias("id"), prepared(F.col(text_column)).alias("line")
    )
    kinds = learned(lines)
    rules = [*RULES, *(rule for rule in CANDIDATES if rule.kind in kinds)]
    spans = found(lines, rules, ["id"])
    more = [
        _true_spans(rule.kind, kinds[rule.kind].weights) if rule.kind in kinds else _no_spans()
        for rule in CANDIDATES
    ]
    return spans.select(
        "id",
        *[rule.kind for rule in RULES],
        *[column.alias(rule.kind) for column, rule in zip(more, CANDIDATES)],
    )


def _true_spans(kind: str, weights: np.ndarray) -> Column:
    return F.filter(kind, lambda span: _is_true(kind, weights, span))


def joined(kinds: Sequence[str]) -> Column:
    """kind:start:end of all spans of the kinds, in their order and then by start."""

    def named(kind: str) -> Column:
        return F.transform(
            kind,
            lambda span: F.concat_ws(
                ":", F.lit(kind), span["start"].cast("string"), span["end"].cast("string")
            ),
        )

    return F.array_join(F.concat(*map(named, kinds)), ",")
