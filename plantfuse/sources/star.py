"""Declared columns of the star-schema tables, with their comments.

Tables left out here (free text and vectors) are only counted, so they are read
under the schema in their files.
"""

from __future__ import annotations

# Column names and types of the given tables.
STAR_DDL = {
    "region": """
        r_regionkey INT COMMENT 'region number',
        r_name STRING COMMENT 'region name'
    """,
    "nation": """
        n_nationkey INT COMMENT 'nation number',
        n_name STRING COMMENT 'nation name',
        n_regionkey INT COMMENT 'region of the nation'
    """,
    "customer": """
        c_custkey BIGINT COMMENT 'customer number',
        c_name STRING COMMENT 'customer name',
        c_nationkey INT COMMENT 'nation of the customer',
        c_acctbal DOUBLE COMMENT 'account balance',
        c_mktsegment STRING COMMENT 'market segment'
    """,
    "supplier": """
        s_suppkey BIGINT COMMENT 'supplier number',
        s_name STRING COMMENT 'supplier name',
        s_nationkey INT COMMENT 'nation of the supplier',
        s_acctbal DOUBLE COMMENT 'account balance'
    """,
    "part": """
        p_partkey BIGINT COMMENT 'part number',
        p_name STRING COMMENT 'part name',
        p_brand STRING COMMENT 'brand',
        p_type STRING COMMENT 'kind of part',
        p_size INT COMMENT 'size',
        p_retailprice DOUBLE COMMENT 'list price'
    """,
    "orders": """
        o_orderkey BIGINT COMMENT 'order number',
        o_custkey BIGINT COMMENT 'customer who ordered',
        o_orderstatus STRING COMMENT 'F, O or P',
        o_totalprice DOUBLE COMMENT 'order value',
        o_orderdate TIMESTAMP_NTZ COMMENT 'day ordered',
        o_orderpriority STRING COMMENT 'priority, digit first'
    """,
    "lineitem": """
        l_orderkey BIGINT COMMENT 'order of the line',
        l_partkey BIGINT COMMENT 'part ordered',
        l_suppkey BIGINT COMMENT 'supplier of the part',
        l_linenumber INT COMMENT 'line within the order',
        l_quantity DOUBLE COMMENT 'quantity',
        l_extendedprice DOUBLE COMMENT 'price of the line',
        l_discount DOUBLE COMMENT 'discount',
        l_tax DOUBLE COMMENT 'tax',
        l_returnflag STRING COMMENT 'return flag',
        l_linestatus STRING COMMENT 'line status',
        l_shipdate TIMESTAMP_NTZ COMMENT 'day shipped'
    """,
    "events": """
        event_id BIGINT COMMENT 'event number',
        ts TIMESTAMP_NTZ COMMENT 'when',
        user_id BIGINT COMMENT 'user concerned',
        event_type STRING COMMENT 'click, error, purchase, signup or view',
        value DOUBLE COMMENT 'value of the event',
        props STRING COMMENT 'further properties as JSON'
    """,
}
