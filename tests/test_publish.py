"""Loads that cannot destroy: staged, checked, then shown by one change."""

import pytest
from pyspark.sql import functions as F

from plantfuse.operators import load, publish
from plantfuse.plans import load_job
from plantfuse.session import shared_path
from plantfuse.sources import TableDef

DDL = "id BIGINT NOT NULL, name VARCHAR(5), kind STRING"
ITEMS = TableDef("items", DDL, key=("id",), defaults={"kind": "plain"}, comment="what there is")


@pytest.fixture
def schema(spark, request):
    name = f"publish_{request.node.name.split('[')[0]}"[:60]
    load.create_schema(spark, name, shared_path(spark, name))
    yield name
    load.drop_schema(spark, name)


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "id BIGINT, name STRING")


def shown(spark, schema):
    return sorted(tuple(r) for r in spark.table(f"{schema}.items").collect())


TEN = [(n, f"n{n}") for n in range(10)]


@pytest.mark.parametrize(
    "bad, message",
    [
        ([(1, "a"), (1, "b")], "PRIMARY KEY id: 1"),
        ([(1, "a"), (None, "b")], "NULL in column id"),
        ([(1, "far too long")], "EXCEED_LIMIT_LENGTH"),
    ],
)
def test_refused_rows_leave_the_table_as_it_was(spark, schema, bad, message):
    load_job.load_table(spark, schema, ITEMS, rows(spark, *TEN))
    before = shown(spark, schema)
    assert before == [(n, name, "plain") for n, name in TEN]
    with pytest.raises(Exception, match=message):
        load_job.load_table(spark, schema, ITEMS, rows(spark, *bad))
    assert shown(spark, schema) == before
    tables = [r.tableName for r in spark.sql(f"SHOW TABLES IN {schema}").collect()]
    assert tables == ["items"]


def test_a_reader_goes_on_with_the_rows_it_began_with(spark, schema):
    load_job.load_table(spark, schema, ITEMS, rows(spark, *TEN))
    begun = spark.table(f"{schema}.items")
    load_job.load_table(spark, schema, ITEMS, rows(spark, (77, "new")))
    assert begun.count() == 10
    assert shown(spark, schema) == [(77, "new", "plain")]
    comment = spark.sql(f"DESCRIBE EXTENDED {schema}.items").where("col_name = 'Comment'")
    assert comment.first().data_type == "what there is"


def test_a_table_of_the_load_that_is_refused_stops_all_of_them(spark, schema):
    others = TableDef("others", "id BIGINT NOT NULL", key=("id",))
    good = spark.range(3)
    load_job.load_tables(spark, schema, [(ITEMS, rows(spark, *TEN)), (others, good)])
    with pytest.raises(load_job.LoadError, match="others breaks PRIMARY KEY id: 3"):
        load_job.load_tables(
            spark, schema, [(ITEMS, rows(spark, (1, "x"))), (others, good.union(good))]
        )
    assert len(shown(spark, schema)) == 10
    assert spark.table(f"{schema}.others").count() == 3


def test_of_two_loads_begun_together_the_second_is_refused(spark, schema):
    load_job.load_table(spark, schema, ITEMS, rows(spark, *TEN))
    one = load_job.stage_table(spark, schema, ITEMS, rows(spark, (1, "one")))
    two = load_job.stage_table(spark, schema, ITEMS, rows(spark, (2, "two")))
    publish.publish(spark, two)
    with pytest.raises(publish.StaleStage):
        publish.publish(spark, one)
    assert shown(spark, schema) == [(2, "two", "plain")]
    assert len(publish.versions(spark, f"{schema}.items")) == 2


def test_earlier_loads_expire(spark, schema):
    name = f"{schema}.items"
    for n in range(4):
        load_job.load_table(spark, schema, ITEMS, rows(spark, (n, "x")))
    assert len(publish.versions(spark, name)) == 4
    gone = publish.expire(spark, name, keep=1)
    assert len(gone) == 2 and len(publish.versions(spark, name)) == 2
    assert publish.expire(spark, name, keep=1) == []
    assert shown(spark, schema) == [(3, "x", "plain")]


def test_other_columns_or_types_are_refused(spark, schema):
    load.create_table(spark, f"{schema}.items", "id BIGINT, name VARCHAR(9), kind STRING")
    with pytest.raises(load_job.LoadError, match="name"):
        load_job.load_table(spark, schema, ITEMS, rows(spark, *TEN))
    wider = TableDef("wider", "id BIGINT, at INT")
    load.create_table(spark, f"{schema}.wider", "id BIGINT, at BIGINT")
    with pytest.raises(load_job.LoadError, match="at"):
        load_job.load_table(spark, schema, wider, spark.range(1).withColumn("at", F.lit(1)))


def test_an_empty_load_and_columns_in_another_order(spark, schema):
    frame = rows(spark, (5, "e")).select("name", "id")
    load_job.load_table(spark, schema, ITEMS, frame)
    assert shown(spark, schema) == [(5, "e", "plain")]
    load_job.load_table(spark, schema, ITEMS, frame.where("false"))
    assert shown(spark, schema) == []
