"""Quoted passages linked to the messages they quote, and conversations in reply order.

A line's quote level is the number of ``>`` in its leading ``>``, blanks and
tabs. Neighbouring lines of one level, up to an empty one, are a passage; it is
normalised (white space one space, trimmed, lower case) and hashed, as is each
of its lines. A line of level 0 that ends in "wrote:" or the like and stands
before a quote introduces it and is no text of the message.

The original of a passage is the first message of the conversation that says it
in its own words (level 0) before the quoting one does; failing that, the first
message of another conversation. A message that says a passage only as a quote
is no original. Passages are matched whole, then by each of their lines, the
longest first, so that a quote with changed lines is found by any that is not. A
message replies to the original of its least deeply quoted linked passage of its own
conversation, the first of these.

Threads are followed by doubling, in rounds as many as the logarithm of their
depth. In reply order a conversation's threads follow their first messages and
each thread its turns, so that a reply comes after what it replies to; positions
come from a range-partitioned table, never from one conversation in one task.
Originals are summed to one row for each hash and conversation, and to the two
least conversations of each hash, before they are joined: what is said in a third
of all messages is no pair of messages. The second conversation serves a quote
that stands in the first.

Only DataFrame functions run. NULL and empty texts are empty messages. A NULL
conversation or turn is a value like others, before all others. Rows of the same
conversation and turn are one message to links, which take the least reply;
each row keeps its own text and quotes. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantfuse.llm.shared import written
from plantfuse.operators.keys import with_generated_key
from plantfuse.session import removed_at_exit, shared_path

# How a quote is introduced, in several languages.
INTRODUCTIONS = "wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe|ha scritto|escreveu"
INTRODUCES = rf"(?i)(^|[\s>\]])({INTRODUCTIONS})\s*:\s*$"

# Control characters that part passages from each other and levels from texts.
PASSAGE, LEVEL = "\x01", "\x02"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " ")))


def hashed(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _shifted(lines: Column, by: int) -> Column:
    """The lines before (-1) or after (1) each line, NULL at the end."""
    none = F.array(F.lit(None).cast("string"))
    if by < 0:
        return F.concat(none, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), none)


def _prefix(line: Column) -> Column:
    return F.regexp_extract(line, "^([> \t]*)", 1)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(_prefix(line), "[ \t]", ""))


def _body(line: Column) -> Column:
    """The line without the marks of its quote."""
    return F.when(_level(line) > 0, F.substr(line, F.length(_prefix(line)) + 1)).otherwise(line)


def _is_introduction(line: Column, after: Column) -> Column:
    return (_level(line) == 0) & line.rlike(INTRODUCES) & (F.coalesce(_level(after), F.lit(0)) > 0)


def parsed(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, own text without quotes, and passages as (level, body) structs."""
    lines = messages.select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.split(
            F.translate(F.coalesce(F.col(text), F.lit("")), PASSAGE + LEVEL + "\r", "  "), "\n"
        ).alias("lines"),
    )
    # An introduction becomes NULL, and parts the passages beside it.
    lines = lines.withColumn(
        "lines",
        F.zip_with(
            "lines",
            _shifted(F.col("lines"), 1),
            lambda line, after: F.when(~_is_introduction(line, after), line),
        ),
    )
    marked = F.zip_with(
        "lines",
        _shifted(F.col("lines"), -1),
        lambda line, before: F.when(
            before.isNotNull()
            & (_level(line) == _level(before))
            & (F.trim(_body(line)) != "")
            & (F.trim(_body(before)) != ""),
            F.concat(F.lit("\n"), _body(line)),
        ).otherwise(F.concat(F.lit(PASSAGE), _level(line).cast("string"), F.lit(LEVEL), _body(line))),
    )
    passages = F.transform(
        F.filter(F.split(F.array_join(marked, ""), PASSAGE), lambda passage: passage != ""),
        lambda passage: F.struct(
            F.regexp_extract(passage, f"^([0-9]+){LEVEL}", 1).cast("int").alias("level"),
            F.regexp_replace(passage, f"^[0-9]+{LEVEL}", "").alias("body"),
        ),
    )
    own = F.array_join(F.filter("lines", lambda line: _level(line) == 0), "\n")
    return lines.select(
        "conv",
        "turn",
        "role",
        F.btrim(own, F.lit(" \t\n\x0b\x0c")).alias("own"),
        F.filter(passages, lambda passage: F.trim(passage["body"]) != "").alias("passages"),
    )


def _keys(body: Column) -> Column:
    """The normalised passage, then its lines, the longest and of these the first first."""
    lines = F.filter(F.transform(F.split(body, "\n"), normalised), lambda line: line != "")
    ranked = F.transform(
        lines, lambda line, at: F.struct((-F.length(line)).alias("size"), at.alias("at"), line.alias("line"))
    )
    return F.concat(F.array(normalised(body)), F.array_sort(ranked)["line"])


def quoted_passages(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """A row for each quoted passage: conv, turn, number, level, passage, hash, and its original.

    ``original_conv`` and ``original_turn`` are NULL where no message is found;
    ``linked`` says whether one is.
    """
    return _linked(written(parsed(messages, conversation, turn, role, text), "parsed-messages"))


def _linked(messages: DataFrame) -> DataFrame:
    passages = messages.select("conv", "turn", F.posexplode("passages").alias("number", "passage"))
    quoted = passages.where("passage.level > 0").select(
        F.monotonically_increasing_id().alias("quote"),
        "conv",
        "turn",
        "number",
        "passage.level",
        normalised(F.col("passage.body")).alias("passage"),
        F.transform(_keys(F.col("passage.body")), hashed).alias("keys"),
    )
    # Written, so that a quote's number does not change.
    quoted = written(quoted, "quoted-passages")
    asked = quoted.select("quote", "conv", "turn", F.posexplode("keys").alias("rank", "hash"))
    # Only hashes that someone quotes can be originals' hashes of use.
    wanted = asked.select("hash").distinct()
    own = passages.where("passage.level = 0").select(
        "conv",
        "turn",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array(normalised(F.col("passage.body"))),
                    F.transform(F.split("passage.body", "\n"), normalised),
                )
            )
        ).alias("said"),
    )
    own = own.select("conv", "turn", hashed(F.col("said")).alias("hash")).join(
        wanted, "hash", "left_semi"
    )
    # Structs, so that a NULL turn or conversation is least and not left out.
    here = written(
        own.groupBy("hash", "conv").agg(F.min(F.struct("turn")).alias("first")), "originals-here"
    )
    place = F.row_number().over(Window.partitionBy("hash").orderBy(F.struct("conv")))
    least = here.withColumn("place", place).where("place <= 2")
    anywhere = least.groupBy(F.col("hash").alias("said")).agg(
        *[
            F.max(F.when(F.col("place") == n, F.struct("conv", "first"))).alias(name)
            for n, name in ((1, "one"), (2, "two"))
        ]
    )
    said_here = here.select(
        F.col("hash").alias("said"), F.col("conv").alias("said_conv"), F.col("first").alias("said_first")
    )
    same = (F.col("hash") == F.col("said")) & F.col("conv").eqNullSafe(F.col("said_conv"))
    before = (
        asked.join(said_here, same)
        .where(F.col("said_first") < F.struct("turn"))
        .groupBy(F.col("quote").alias("of_quote"))
        .agg(F.min(F.struct("rank", "said_first")).alias("found"))
        .select("of_quote", F.col("found.said_first.turn").alias("turn_here"))
    )
    one_is_own = F.col("one.conv").eqNullSafe(F.col("conv"))
    elsewhere = (
        asked.join(anywhere, F.col("hash") == F.col("said"))
        .withColumn("far", F.when(one_is_own, F.col("two")).otherwise(F.col("one")))
        .where(F.col("far").isNotNull())
        .groupBy(F.col("quote").alias("far_quote"))
        .agg(F.min(F.struct("rank", "far")).alias("found"))
        .select(
            "far_quote",
            F.struct(
                F.col("found.far.conv").alias("conv"), F.col("found.far.first.turn").alias("turn")
            ).alias("far"),
        )
    )
    quoted = quoted.join(before, F.col("quote") == F.col("of_quote"), "left").join(
        elsewhere, F.col("quote") == F.col("far_quote"), "left"
    )
    here_found = F.struct("conv", F.col("turn_here").alias("turn"))
    original = F.coalesce(F.when(F.col("of_quote").isNotNull(), here_found), F.col("far"))
    return quoted.withColumn("original", original).select(
        "conv",
        "turn",
        "number",
        "level",
        "passage",
        F.hex(F.get("keys", F.lit(0))).alias("hash"),
        F.col("original").isNotNull().alias("linked"),
        F.col("original.conv").alias("original_conv"),
        F.col("original.turn").alias("original_turn"),
    )


def _threads(replies: DataFrame) -> DataFrame:
    """conv, turn, parent, root and depth of each message that replies, by doubling.

    ``replies`` has a row for each: conv, turn, and parent as a struct of a turn.
    """
    top = replies.withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("long")}).checkpoint()
    while True:
        above = top.select(
            F.col("conv").alias("up_conv"),
            F.struct("turn").alias("up"),
            F.col("root").alias("up_root"),
            F.col("depth").alias("up_depth"),
        )
        step = top.join(
            above, F.col("conv").eqNullSafe(F.col("up_conv")) & (F.col("root") == F.col("up")), "left"
        )
        if step.where(F.col("up").isNotNull()).isEmpty():
            return top
        top = step.select(
            "conv",
            "turn",
            "parent",
            F.coalesce("up_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"),
        ).checkpoint()


def reply_ordered(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Every message without its quotes, with its place among the replies.

    Columns: conversation, turn, role, text, ``n_quotes`` (quoted passages),
    ``n_linked``, ``deepest`` (quote level), ``reply_to`` (turn, NULL if to
    none), ``thread`` (turn of the thread's first message), ``depth`` and
    ``reply_order``, from 1 within the conversation.
    """
    spark = messages.sparkSession
    split = written(parsed(messages, conversation, turn, role, text), "parsed-messages")
    passages = written(_linked(split), "linked-passages")
    inside = passages.where(F.col("linked") & F.col("original_conv").eqNullSafe(F.col("conv")))
    original = F.struct(F.col("original_turn").alias("turn")).alias("parent")
    replies = (
        inside.groupBy("conv", "turn")
        .agg(F.min(F.struct("level", "number", original)).alias("reply"))
        .select("conv", "turn", "reply.parent")
    )
    threads = _threads(replies)
    quotes = F.filter("passages", lambda passage: passage["level"] > 0)
    counted = passages.where("linked").groupBy("conv", "turn").agg(F.count("*").alias("linked"))
    found = _beside(_beside(split, threads), counted).select(
        "conv",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.size(quotes).cast("long").alias("n_quotes"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_max(F.transform("passages", lambda passage: passage["level"])), F.lit(0))
        .cast("long")
        .alias("deepest"),
        F.col("parent.turn").alias("reply_to"),
        F.coalesce("root", F.struct("turn"))["turn"].alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    order = ["conv", "thread", "turn", "role", "text"]
    path = shared_path(spark, "llm-reply-order")
    numbered = written(with_generated_key(found, "at", order, path), "reply-order")
    removed_at_exit(spark, path)
    first = numbered.groupBy("conv").agg(F.min("at").alias("first")).checkpoint()
    return (
        numbered.join(
            first.withColumnRenamed("conv", "first_conv"), F.col("conv").eqNullSafe(F.col("first_conv"))
        )
        .withColumn("reply_order", F.col("at") - F.col("first") + 1)
        .drop("at", "first", "first_conv")
        .withColumnsRenamed({"conv": conversation, "turn": turn, "role": role})
    )


def _beside(messages: DataFrame, more: DataFrame) -> DataFrame:
    more = more.withColumnsRenamed({"conv": "more_conv", "turn": "more_turn"})
    return messages.join(
        more,
        messages["conv"].eqNullSafe(more["more_conv"]) & messages["turn"].eqNullSafe(more["more_turn"]),
        "left",
    ).drop("more_conv", "more_turn")
