import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from plantfuse.llm import line_dedup
from plantfuse.llm.queries import ORACLE_SQL, op10_line_dedup

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[lower(line.strip(SPACE))].add(doc_id)
    kept_in = {
        key: max(ids, key=lambda i: (i is not None, i or 0))
        for key, ids in held.items()
        if len(key) >= min_chars and len(ids) >= min_docs
    }
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if kept_in.get(lower(line.strip(SPACE)), doc_id) == doc_id
        ]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def made(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.without_shared_lines(frame, result="r", **options)
    return sorted(
        (tuple(row) for row in found.select("doc_id", "r.kept", "r.n_lines", "r.n_dropped").collect()),
        key=str,
    )


@pytest.mark.parametrize("max_filter_bytes", [1 << 13, 32 << 20])
def test_against_brute_force(spark, max_filter_bytes):
    rng = random.Random(5)
    pool = [
        ("é" if n % 3 else "Q") * rng.choice([20, 39, 40, 41, 60]) + str(n % 9) for n in range(40)
    ]
    rows = [(None, None), (None, pool[1]), (-1, ""), (7, "x"), (7, pool[1] + "\n" + pool[1])]
    for doc_id in range(60):
        lines = [
            rng.choice([" ", "\t", "\x0b", "\xa0", ""]) + rng.choice([str.upper, lower])(line)
            for line in rng.choices(pool, k=rng.randrange(8))
        ]
        rows.append((doc_id, "\n".join(lines)))
    rows += rows[-3:]
    assert made(spark, rows, max_filter_bytes=max_filter_bytes) == brute(rows)


def test_a_line_of_all_documents_and_a_very_long_text(spark):
    line = "a line that every one of the documents holds"
    rows = [(n, line + f"\nonly here {n}") for n in range(300)]
    rows.append((300, "\n".join([line] * 20_000)))
    assert made(spark, rows) == brute(rows)


def test_no_rows_and_clashing_columns(spark):
    frame = spark.createDataFrame(
        [(1, "a", "k", 2)], "doc_id long, text string, key string, `line_dedup_keys.x` int"
    )
    found = line_dedup.without_shared_lines(frame, result="done")
    assert found.columns == [*frame.columns, "done"]
    assert found.where("done.kept = 'a'").count() == 1
    assert line_dedup.without_shared_lines(frame.limit(0)).count() == 0


def test_the_filter_grows_with_the_text_up_to_its_bound():
    assert line_dedup.filter_bits(0, 1 << 20) == line_dedup.BLOCK_BITS
    assert line_dedup.filter_bits(1 << 22, 1 << 20) == 1 << 19
    assert line_dedup.filter_bits(1 << 50, 1 << 20) == 8 << 20


def test_filters_of_tasks_add_up(spark):
    rows = [(f"{n % 50:040d}",) for n in range(60)] + [(f"{9:040d}\n{9:040d}",), (None,)]
    texts = spark.createDataFrame(rows, "text string").select(F.col("text").cast("binary"))
    bits = line_dedup.BLOCK_BITS
    blocks = line_dedup.twice_seen(texts.repartition(7), 40, bits).collect()
    assert len(blocks) == 1
    number = int.from_bytes(blocks[0].bits, "big")
    twice = {n for n in range(bits) if number >> (bits - 1 - n) & 1}
    keys = [f"{n:040d}".encode() for n in range(10)]
    assert twice == set(line_dedup.places(keys, bits).tolist())


def test_query_against_its_sql(spark, sf_dir):
    documents = duckdb.read_parquet(f"{sf_dir}/documents.parquet")
    wanted = duckdb.sql(ORACLE_SQL["op10_line_dedup"]).fetchall() if documents else []
    found = [tuple(row) for row in op10_line_dedup(spark, sf_dir).collect()]
    assert sorted(found) == sorted(wanted)
    assert any(row[2] for row in found)
