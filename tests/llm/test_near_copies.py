"""Near copies by sampled SimHashes, against the plain Jaccard index of shingles."""

from pathlib import Path

import numpy as np
import pytest

from plantfuse.llm import graph, near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))} if words else set()


def index(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def random_text(rng, words):
    return " ".join(f"w{n}" for n in rng.integers(0, 5000, words))


def edited(rng, text, edits):
    """Words replaced, deleted and inserted at random places."""
    words = text.split()
    for _ in range(edits):
        at = int(rng.integers(0, len(words)))
        kind = rng.integers(0, 3)
        if kind == 0:
            words[at] = f"x{rng.integers(0, 9**9)}"
        elif kind == 1 and len(words) > 6:
            del words[at]
        else:
            words.insert(at, f"y{rng.integers(0, 9**9)}")
    return " ".join(words)


def found(spark, rows, parts=4, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {row.id: row.component for row in near_copies.near_copies(docs, **more).collect()}


# Words, and edits that leave an index of 0.8 or more in most texts.
SIZES = {60: (1,), 300: (1, 3, 5), 1000: (3, 10, 18)}


@pytest.mark.parametrize("words", SIZES)
def test_recall_at_an_index_of_four_fifths(spark, words):
    rng = np.random.default_rng(words)
    pairs, rows = [], []
    for number in range(240):
        text = random_text(rng, words)
        copy = edited(rng, text, SIZES[words][number % len(SIZES[words])])
        pairs.append((2 * number, index(text, copy)))
        rows += [(2 * number, text), (2 * number + 1, copy)]
    got = found(spark, rows)
    high = [got[at + 1] == at for at, similarity in pairs if similarity >= 0.8]
    assert len(high) > 150
    assert sum(high) / len(high) >= 0.9
    # Not one of the others, nor any two of different texts.
    assert all(got[at + 1] == at + 1 for at, similarity in pairs if similarity < 0.75)
    assert all(component // 2 == at // 2 for at, component in got.items())


def test_texts_that_share_a_passage_stay_apart(spark):
    rng = np.random.default_rng(1)
    passage = random_text(rng, 80)
    rows = [(n, f"{random_text(rng, 60)} {passage} {random_text(rng, 60)}") for n in range(300)]
    rows += [(1000 + n, edited(rng, rows[n][1], 2)) for n in range(100)]
    got = found(spark, rows)
    assert all(got[n] == n for n in range(300))
    linked = [got[1000 + n] == n for n in range(100) if index(rows[n][1], rows[300 + n][1]) >= 0.8]
    assert len(linked) > 80 and sum(linked) / len(linked) >= 0.9


def test_a_large_group_of_near_copies_is_one(spark):
    rng = np.random.default_rng(2)
    text = random_text(rng, 200)
    rows = [(n, edited(rng, text, 1)) for n in range(400)] + [(900 + n, text) for n in range(200)]
    got = found(spark, rows)
    assert sum(component == 0 for component in got.values()) >= 0.99 * len(rows)


def test_odd_texts_ids_and_tables(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one three")]
    rows += [(None, "a text of six words here"), (None, "a text of six words here")]
    rows += [(7, "repeated id with a text"), (7, "another text of the same id")]
    rows += [(8, "long " * 30_000), (9, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, near_copies.near_copies(docs).collect()))
    assert len(got) == len(rows)
    by_id = {row.id: row.component for row in near_copies.near_copies(docs).collect()}
    assert (by_id[1], by_id[2], by_id[3]) == (1, 1, 1)
    assert (by_id[4], by_id[5], by_id[6], by_id[7], by_id[9]) == (4, 4, 6, 7, 8)
    assert by_id[None] is None
    assert near_copies.near_copies(docs.where("false")).collect() == []


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)],
        "doc_id int, text string, key int, component int, size int",
    )
    assert sorted(map(tuple, near_copies.near_copies(docs).collect())) == [(1, 1), (2, 1)]


def test_the_index_of_sketches():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(200):
        whole = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
        left, right = whole[rng.random(len(whole)) < 0.9], whole[rng.random(len(whole)) < 0.9]
        exact = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
        least = near_copies.SKETCH
        errors.append(near_copies.jaccard(left[:least], right[:least]) - exact)
    assert np.std(errors) < 0.025 and abs(np.mean(errors)) < 0.01
    few = np.arange(50, dtype=np.uint64)
    assert near_copies.jaccard(few[:40], few[10:]) == 30 / 50


def least_ids(rows):
    """The least id that each id reaches, from all pairs of texts."""
    of_rows = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(at):
        while root[at] != at:
            at = root[at]
        return at

    for at, mine in enumerate(of_rows):
        for other in range(at):
            shared = len(mine & of_rows[other])
            if shared >= 0.8 * (len(mine) + len(of_rows[other]) - shared):
                a, b = sorted((top(at), top(other)))
                root[b] = a
    return {number: rows[top(at)][0] for at, (number, _) in enumerate(rows)}


def test_no_pair_of_a_large_group_is_left_out(spark):
    # All share a passage, and copies are longer than many other texts of the group.
    rng = np.random.default_rng(5)
    passage = random_text(rng, 200)
    rows = [(n, f"{passage} {random_text(rng, int(rng.integers(60, 140)))}") for n in range(200)]
    rows += [
        (1000 + n, f"{text} {random_text(rng, int(rng.integers(0.15 * 250, 0.24 * 260)))}")
        for n, text in rows
    ]
    want = least_ids(rows)
    assert sum(want[1000 + n] == n for n in range(200)) > 150
    assert found(spark, rows) == want


def test_all_links_of_texts_at_and_around_the_least_index(spark):
    rng = np.random.default_rng(6)
    rows = []
    for words, most in ((30, 3), (120, 6), (700, 30), (1500, 60)):
        for _ in range(40):
            text = random_text(rng, words)
            copies = [text, *(edited(rng, text, int(rng.integers(1, most))) for _ in range(3))]
            rows += [(len(rows) + n, copy) for n, copy in enumerate(copies)]
    rows.append((len(rows), " ".join(f"e{n}" for n in range(12))))
    rows.append((len(rows), " ".join(f"e{n}" for n in range(14))))  # 8 of 10 shingles
    want = least_ids(rows)
    assert want[len(rows) - 1] == len(rows) - 2
    assert 300 < len(set(want.values())) < 500
    assert found(spark, rows) == want


def test_chains_through_texts_that_are_not_alike(spark):
    words = [f"c{n}" for n in range(400)]
    rows = [(n, " ".join(words[10 * n : 10 * n + 200])) for n in range(20)]
    assert set(found(spark, rows).values()) == {0}
    assert index(rows[0][1], rows[-1][1]) < 0.1


def left_behind(spark):
    """The tables in the shared folder, and the files of checkpoints."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return set((shared / "plantfuse").glob("llm-*")), set(shared.glob("*/rdd-*/*"))


def test_rounds_of_components_leave_only_their_result(spark):
    chain = [(n + 1, n) for n in range(40)] + [(100 + n, 100) for n in range(1, 20)] + [(7, 7)]
    links = spark.createDataFrame(chain, "a long, b long").repartition(7)
    tables, files = left_behind(spark)
    got = {node: root for node, root in graph.components(links).collect()}
    assert got == {n: 0 for n in range(41)} | {100 + n: 100 for n in range(20)}
    more, more_files = left_behind(spark)
    assert more_files == files
    assert {path.name.rsplit("-", 1)[0] for path in more - tables} <= {"llm-roots"}


def test_tables_go_once_they_are_read(spark):
    rng = np.random.default_rng(8)
    texts = [random_text(rng, 200) for _ in range(30)]
    rows = [(n, edited(rng, texts[n % 30], n // 30)) for n in range(90)]
    tables, files = left_behind(spark)
    assert found(spark, rows) == least_ids(rows)
    more, more_files = left_behind(spark)
    assert more_files == files
    names = {path.name.rsplit("-", 1)[0] for path in more - tables}
    gone = "sample-words sample-groups in-groups candidate-pairs hash-sets met-prefixes rest-pairs"
    assert "llm-text-roots" in names or "llm-firsts" in names
    assert not names & {f"llm-{name}" for name in [*gone.split(), "links", "least"]}


@pytest.fixture
def many_partitions(spark):
    """Sixty partitions after a shuffle, however little they hold."""
    put = {
        "spark.sql.shuffle.partitions": "60",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in put}
    for name, value in put.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_small_tables_of_the_rounds_are_few_files(spark, many_partitions, monkeypatch):
    files = {}

    def counted(frame, label, most=None, passing=graph.passing):
        table, drop = passing(frame, label, most)
        rows = table.count()
        assert most is None or rows <= most
        files.setdefault(label, []).append(len(table.inputFiles()))
        return table, drop

    monkeypatch.setattr(graph, "passing", counted)
    chain = [(n + 1, n) for n in range(400)] + [(1000 + n, 1000) for n in range(1, 200)]
    links = spark.createDataFrame(chain, "a long, b long").repartition(7)
    got = dict(graph.components(links, len(chain)).collect())
    assert got == {n: 0 for n in range(401)} | {1000 + n: 1000 for n in range(200)}
    assert len(files["least"]) > 3 and set(files["least"]) == set(files["links"]) == {1}


def test_stars_are_known(spark):
    def stars(*links):
        return graph._are_stars(spark.createDataFrame(list(links), "node long, other long"))

    assert stars((2, 1), (3, 1), (5, 4)) and stars()
    assert not stars((2, 1), (3, 2)) and not stars((3, 1), (3, 2))


def test_parities_drop_no_link_and_most_other_pairs(spark):
    rng = np.random.default_rng(10)
    rows, indexes = [], []
    for size in (1, 4, 9, 50, 300, 2000):
        for share in (0.7, 0.8, 0.88, 0.9, 0.95, 1.0):
            whole = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            fresh = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            kept = int(np.ceil(share * len(whole)))
            other = np.unique(np.concatenate([whole[:kept], fresh[kept:]]))
            sides = [
                (len(one), near_copies.parities(one).tolist()) for one in (whole, other)
            ]
            indexes.append(near_copies.whole_index(whole, other))
            rows.append((len(rows), *sides))
    side = "struct<size: long, parities: array<long>>"
    frame = spark.createDataFrame(rows, f"number int, one {side}, two {side}")
    may = {row.number for row in frame.where(near_copies.may_reach(0.8)).collect()}
    assert {number for number, index in enumerate(indexes) if index >= 0.8} <= may
    # An index of 0.54 of up to 300 shingles is seen by the parities alone.
    low = {n for n, (_, one, _) in enumerate(rows) if indexes[n] < 0.6 and 50 <= one[0] <= 300}
    assert len(low) >= 2 and not low & may
