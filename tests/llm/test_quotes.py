import random
import re

import duckdb
import pytest

from plantfuse.llm import quotes
from plantfuse.llm.queries import ORACLE_SQL, op1_quote_linking

COLUMNS = "conv_id turn role text n_quotes n_linked deepest reply_to thread depth reply_order".split()


def normal(text):
    return re.sub(r"\s+", " ", text).strip(" ").lower()


def parse(text):
    lines = (text or "").translate({1: " ", 2: " ", 13: None}).split("\n")
    marks = [re.match("[> \t]*", line)[0] for line in lines]
    levels = [mark.count(">") for mark in marks]
    own, passages, open_at = [], [], None
    for at, line in enumerate(lines):
        level = levels[at]
        after = levels[at + 1] if at + 1 < len(lines) else 0
        if level == 0 and after > 0 and re.search(quotes.INTRODUCES, line):
            open_at = None
            continue
        body = line[len(marks[at]) :] if level else line
        if level == 0:
            own.append(line)
        if not body.strip(" "):
            open_at = None
        elif open_at == level:
            passages[-1][1].append(body)
        else:
            passages.append((level, [body]))
            open_at = level
    return "\n".join(own).strip(" \t\n\x0b\x0c"), passages


def rank(value):
    return (value is not None, value or 0)


def brute(rows):
    """(conv, turn, role, text) rows to all columns of the operator."""
    split = [(conv, turn, role, *parse(text)) for conv, turn, role, text in rows]
    said = {}
    for conv, turn, _, _, passages in split:
        for level, lines in passages:
            if level == 0:
                for key in {normal("\n".join(lines)), *map(normal, lines)}:
                    said.setdefault(key, []).append((rank(conv), rank(turn)))
    links = {}
    for conv, turn, _, _, passages in split:
        for number, (level, lines) in enumerate(passages):
            if not level:
                continue
            of_lines = [line for line in map(normal, lines) if line]
            keys = [normal("\n".join(lines)), *sorted(of_lines, key=len, reverse=True)]
            here = [min((t for c, t in said.get(key, []) if c == rank(conv)), default=None) for key in keys]
            here = [t for t in here if t is not None and t < rank(turn)]
            far = [c for key in keys for c, _ in said.get(key, []) if c != rank(conv)]
            links.setdefault((rank(conv), rank(turn)), []).append(
                (level, number, here[0] if here else None, bool(here or far))
            )
    parent = {
        key: min((level, number, t) for level, number, t, _ in found if t)[2]
        for key, found in links.items()
        if any(t for _, _, t, _ in found)
    }
    out = []
    for conv, turn, role, own, passages in split:
        root, depth = rank(turn), 0
        while (rank(conv), root) in parent:
            root, depth = parent[rank(conv), root], depth + 1
        up = parent.get((rank(conv), rank(turn)))
        linked = sum(ok for *_, ok in links.get((rank(conv), rank(turn)), []))
        value = lambda ranked: ranked[1] if ranked and ranked[0] else None
        out.append([conv, turn, role, own, sum(level > 0 for level, _ in passages), linked,
                    max((level for level, _ in passages), default=0), value(up), value(root), depth])
    key = lambda row: (rank(row[0]), rank(row[8]), rank(row[1]), (row[2] is not None, row[2] or ""), row[3])
    out.sort(key=key)
    places = {}
    for row in out:
        places[row[0]] = places.get(row[0], 0) + 1
        row.append(places[row[0]])
    return [tuple(row) for row in out]


def found(spark, rows):
    frame = spark.createDataFrame(
        [(*row, "x", 1) for row in rows],
        "conv_id long, turn long, role string, text string, hash string, conv int",
    )
    return sorted(quotes.reply_ordered(frame).select(COLUMNS).collect(), key=str)


def thread_rows(rng, conv, length):
    rows = []
    for turn in range(length):
        lines = [f"Sentence {rng.randrange(30)} by {conv % 3}." for _ in range(rng.randrange(1, 4))]
        parts = ["\n".join(lines)]
        for _ in range(rng.randrange(3)):
            if rows:
                quoted = rng.choice(rows)[3] or ""
                mark = rng.choice(["> ", ">", " > > "])
                intro = rng.choice(["", "On Monday Ann wrote:\n", "Er schrieb :\n"])
                body = "\n".join(mark + line.upper() for line in quoted.split("\n"))
                parts.insert(rng.randrange(len(parts) + 1), intro + body)
        rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["\n", "\n\n"]).join(parts)))
    return rows


def test_parsing(spark):
    text = "Hi\n\nAnn wrote:\n> first  line\n> second\n>> deep\n>\n> third\nMine\x01\r\nwrote:\n"
    frame = spark.createDataFrame([(1, 1, "r", text)], "c int, t int, r string, x string")
    row = quotes.parsed(frame, "c", "t", "r", "x").first()
    assert row.own == parse(text)[0] == "Hi\n\nMine \nwrote:"
    assert [(p.level, p.body) for p in row.passages] == [
        (0, "Hi"), (1, "first  line\nsecond"), (2, "deep"), (1, "third"), (0, "Mine \nwrote:"),
    ]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [row for conv in range(12) for row in thread_rows(rng, conv, rng.randrange(1, 9))]
    rows += [(None, None, None, None), (None, 1, "user", "Sentence 3 by 0."), (None, 2, "user", "> sentence 3 BY 0.")]
    rows += [(50, None, "user", "No turn here."), (50, 0, "a", "> no turn   here."), (50, 1, "b", "")]
    rows += [(3, 0, "user", "> Said before it was said"), (3, 1, "user", "Said before it was said")]
    rows += [(51, 0, "a", "twice"), (51, 0, "a", "twice"), (51, 0, "b", "> twice")]
    assert found(spark, rows) == sorted(brute(rows), key=str)
    assert found(spark, []) == []


def test_one_long_thread_and_a_very_common_passage(spark):
    rows = [(1, 0, "u", "message 0\ncommon words of all")]
    rows += [(1, n, "u", f"> message {n - 1}\nmessage {n}\ncommon words of all") for n in range(1, 70)]
    rows += [(n, 0, "u", "> common words of all\n" * 50) for n in range(2, 60)]
    rows += [(99, 0, "u", "\n".join(f"line {n}" for n in range(30_000)) + "\n" + ">" * 5_000 + "x")]
    got = found(spark, rows)
    assert got == sorted(brute(rows), key=str)
    assert max(row.depth for row in got) == 69


def test_no_python_runs(spark, sf_dir):
    plan = op1_quote_linking(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("quoting", [False, True])
def test_query_against_its_sql(spark, sf_dir, tmp_path, quoting):
    if quoting:
        rng = random.Random(8)
        rows = [row for conv in range(15) for row in thread_rows(rng, conv, rng.randrange(1, 9))]
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        sf_dir = str(tmp_path)
        frame.coalesce(1).write.parquet(f"{sf_dir}/conversations.parquet")
        conversations = duckdb.read_parquet(f"{sf_dir}/conversations.parquet/*.parquet")
    else:
        conversations = duckdb.read_parquet(f"{sf_dir}/conversations.parquet")
    wanted = conversations.query("conversations", ORACLE_SQL["op1_quote_linking"])
    assert wanted.columns == COLUMNS
    got = op1_quote_linking(spark, sf_dir).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted.fetchall(), key=str)
    assert not quoting or any(row.reply_to is not None for row in got)


def linked(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {
        (row.conv, row.turn): (row.linked, row.original_conv, row.original_turn)
        for row in quotes.quoted_passages(frame).collect()
    }


def test_a_passage_that_the_own_conversation_says_later_is_found_elsewhere(spark):
    passage = "The same words in all of them."
    rows = [(5, 1, "u", f"> {passage}"), (5, 2, "u", passage), (9, 4, "u", passage), (9, 5, "u", passage)]
    assert linked(spark, rows) == {(5, 1): (True, 9, 4)}
    # Nobody else says it: no message before it does.
    assert linked(spark, rows[:2]) == {(5, 1): (False, None, None)}
    assert linked(spark, [*rows, (2, 7, "u", passage)]) == {(5, 1): (True, 2, 7)}


def test_any_line_that_is_not_changed_links_a_quote(spark):
    said = "A long line that the quoting message has changed.\nA shorter line.\nShort."
    quote = "> A long line that the quoting message changed.\n> A shorter line.\n> short."
    rows = [(1, 1, "u", said), (1, 2, "u", quote), (3, 0, "u", "A shorter line.")]
    assert linked(spark, rows) == {(1, 2): (True, 1, 1)}
    assert linked(spark, rows[1:]) == {(1, 2): (True, 3, 0)}
    # The longest line that somebody says decides, wherever a shorter one is said.
    rows = [(1, 0, "u", "Short."), (1, 1, "u", "A shorter line."), (1, 2, "u", quote)]
    assert linked(spark, rows) == {(1, 2): (True, 1, 1)}
