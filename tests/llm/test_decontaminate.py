import random
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantfuse.llm import decontaminate
from plantfuse.llm.decontaminate import Finder, contaminated, distances, edits_allowed, words_of
from plantfuse.llm.queries import op6_decontaminate


def edit_distances(item, text):
    """The distance of the item to each beginning of the text."""
    row = list(range(len(text) + 1))
    for i, word in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (word != other)))
        row = new
    return row


def brute(docs, items, max_edits=0.2):
    """Every (document, item) with a window within the bound, and its least edits."""
    found = {}
    for doc_id, text in docs:
        words = words_of((text or "").lower())
        for item_id, item in items:
            item = words_of((item or "").lower())
            if len(item) < decontaminate.MIN_WORDS:
                continue
            bound = edits_allowed(len(item), max_edits)
            best = min(
                (min(edit_distances(item, words[at : at + len(item) + bound])))
                for at in range(len(words) + 1)
            )
            if best <= bound:
                found[doc_id, item_id] = best
    return found


@given(
    st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=9),
                       st.lists(st.integers(1, 3), max_size=12), st.integers(0, 4)), min_size=1, max_size=4)
)
@settings(deadline=None)
def test_distances(rows):
    width = max(len(item) for item, _, _ in rows)
    reach = max(len(text) for _, text, _ in rows)
    items = np.array([item + [-1] * (width - len(item)) for item, _, _ in rows])
    texts = np.array([text + [-2] * (reach - len(text)) for _, text, _ in rows]).reshape(len(rows), reach)
    bounds = np.array([bound for _, _, bound in rows])
    edits, end = distances(items, np.array([len(item) for item, _, _ in rows]), texts, bounds)
    for (item, text, bound), found, stop in zip(rows, edits, end):
        exact = edit_distances(item, text)
        if min(exact) <= bound:
            assert (found, stop) == (min(exact), exact.index(min(exact)))
        else:
            assert found > bound


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize(("rate", "recall"), [(0.05, 0.99), (0.1, 0.98), (0.2, 0.9)])
def test_recall_of_edited_items(spark, sf_dir, rate, recall):
    rng = random.Random(int(100 * rate))
    items = [(n, r.text) for n, r in enumerate(spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())]
    vocabulary = [word for _, text in items for word in words_of(text.lower())]
    finder, found, all_ = Finder(items, 0.2), 0, 0
    for _ in range(12):
        texts = []
        for _, text in items:
            words = words_of(text.lower())
            inside = edited(rng, words, max(1, int(rate * len(words))), vocabulary)
            texts.append(" ".join(rng.choices(vocabulary, k=25) + inside + rng.choices(vocabulary, k=25)))
        pairs = {(row[0], row[1]) for row in finder.find(texts)}
        found += sum((n, n) in pairs for n, _ in items)
        all_ += len(items)
    assert found >= recall * all_


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{n}" for n in range(30)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for n in range(12)]
    items += [(12, None), (13, ""), (14, items[-1][1]), (None, "of no id but of words enough to search")]
    docs = [(0, None), (1, ""), (2, "w1"), (None, items[11][1] + "!"), (3, "OF no id, but -- of words ENOUGH to find")]
    for doc_id in range(4, 40):
        parts = rng.choices(vocabulary, k=rng.randrange(20))
        _, item = rng.choice(items[:12])
        parts += item.upper().split() + rng.choices(vocabulary, k=rng.randrange(20))
        docs.append((doc_id, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += docs[-2:]
    frame = spark.createDataFrame([(*doc, 1) for doc in docs], "doc_id long, text string, item long")
    rows = contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    wanted = brute(docs, items)
    got = {(row.doc_id, row.item_id): row.edits for row in rows}
    assert got.items() <= wanted.items()
    assert {key for key, edits in wanted.items() if edits == 0} <= got.keys()
    assert len(got) >= 0.9 * len(wanted)
    texts, by_item = dict(docs), dict(items)
    for row in rows:
        window = words_of(texts[row.doc_id][row.first : row.end].lower())
        item = words_of(by_item[row.item_id].lower())
        assert row.n_words == len(item) and edit_distances(item, window)[-1] == row.edits


def test_items_in_blocks_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = spark.createDataFrame(
        [(n, f"item number {n} has {n} words of its own kind") for n in range(9)],
        "item_id long, text string",
    )
    filler = "nothing to be found in this sentence " * 30_000
    docs = spark.createDataFrame(
        [(1, filler + "Item number 3 has 3 words of its own kind." + filler), (2, "clean")],
        "doc_id long, text string",
    )
    rows = contaminated(docs, items, max_edits=0.0).collect()
    assert [(row.doc_id, row.item_id, row.edits, row.first) for row in rows] == [(1, 3, 0, len(filler))]
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0


def test_a_very_long_item_beside_short_ones():
    rng = random.Random(6)
    long = [f"w{rng.randrange(500)}" for _ in range(6_000)]
    items = [(1, " ".join(long)), (2, "a short item of just a few words")]
    changed = edited(rng, long, 200, ["new"])
    texts = [" ".join(changed) + " a short item of just a few words", "a few words", None]
    rows = {(row[0], row[1]): row for row in Finder(items, 0.2).find(texts)}
    assert rows.keys() == {(0, 0), (0, 1)}
    text, item, first, end, edits = rows[0, 0]
    assert 150 < edits <= 200 and abs(end - first - len(long)) <= 200
    assert rows[0, 1][4] == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(row.doc_id, row.item_id) for row in op6_decontaminate(spark, sf_dir).collect()}
    wanted = {(d, i) for d, text in docs for i, item in items if item in (text or "")}
    assert wanted and found == wanted


@pytest.mark.parametrize("size", [40, 64, 250, 500, 1000])
def test_recall_of_long_items_edited_in_a_fifth_of_their_words(size):
    rng = random.Random(size)
    vocabulary = [f"w{n}" for n in range(20_000)]
    weights = list(accumulate(1 / n for n in range(1, 20_001)))
    drawn = lambda k: rng.choices(vocabulary, cum_weights=weights, k=k)
    items = [drawn(size) for _ in range(60)]
    texts = [drawn(50) + edited(rng, item, size // 5, vocabulary) + drawn(50) for item in items]
    finder = Finder([(n, " ".join(item)) for n, item in enumerate(items)], 0.2)
    rows = finder.find([" ".join(text) for text in texts])
    assert sum(text == item for text, item, *_ in rows) >= 0.95 * len(items)
    for text, item, first, end, edits in rows[:5]:
        assert edits == edit_distances(items[item], texts[text][first:end])[-1] <= size // 5


def test_a_long_item_found_by_parts_in_its_middle_or_at_its_ends():
    rng = random.Random(8)
    item = [f"w{rng.randrange(5000)}" for _ in range(300)]
    new = lambda k: [f"n{rng.randrange(5000)}" for _ in range(k)]
    texts = [
        new(30) + item[30:270] + new(30),
        item[:120] + item[180:],
        item[:150] + new(60) + item[150:],
        item,
        item[:200],
    ]
    texts = [new(40) + text + new(40) for text in texts]
    rows = Finder([(1, " ".join(item))], 0.2).find([" ".join(text) for text in texts])
    assert [(row[0], row[4]) for row in rows] == [(0, 60), (1, 60), (2, 60), (3, 0)]
    assert rows[3][2:4] == (40, 340)


def test_items_of_few_words_and_scripts_without_blanks(spark):
    items = [
        (1, "Yes"),
        (2, "forty-two"),
        (3, "a b a b"),
        (4, "今天天气很好"),
        (5, "東京"),
        (6, "สวัสดีครับ"),
        (7, "yes"),
        (8, "!?"),
        (9, "今天天气很好,我们一起去公园散步吧"),
    ]
    docs = [
        (1, "no, YES and yes"),
        (2, "forty two or fortytwo"),
        (3, "x a b a b a b"),
        (4, "因为今天天气很好所以"),
        (5, "在東京都"),
        (6, "เขาพูดว่าสวัสดีครับแล้วไป"),
        (7, "a b"),
        (8, "a b a"),
        (9, "大家说今天天气真好,我们一起去公园散步吧!"),
        (10, "eyes of a yesterday"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == brute(docs, items)
    places = {(r.doc_id, r.item_id): dict(docs)[r.doc_id][r.first : r.end] for r in rows}
    assert places == {
        (1, 1): "YES",
        (1, 7): "YES",
        (2, 2): "forty two",
        (3, 3): "a b a b",
        (4, 4): "今天天气很好",
        (5, 5): "東京",
        (6, 6): "สวัสดีครับ",
        (9, 4): "今天天气真好",
        (9, 9): "今天天气真好,我们一起去公园散步吧",
    }
