"""Queries give the rows of their SQL where keys are larger than in the test tables, missing or named by one table alone."""

import datetime

import duckdb

from quern.operators import graph
from quern.plans import ORACLES, QUERIES
from tests.test_oracle import same_rows


def checked(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, str(folder)), con, ORACLES[name])


def test_customers_are_no_parts(spark, tmp_path):
    """Customer 5 and part 1000005 are two nodes; customer 9 is in orders alone, and one order is nobody's."""
    checked(
        spark, tmp_path, "region_subgraph",
        customer=([(5,), (6,), (-7,)], "c_custkey long"),
        part=([(5, "Brand#2"), (7, "Brand#1"), (1_000_005, "Brand#2"), (1_000_006, "Brand#1"), (None, "Brand#2")], "p_partkey long, p_brand string"),
        orders=([(1, 5), (2, 6), (3, 9), (4, None), (5, -7)], "o_orderkey long, o_custkey long"),
        lineitem=([(k, p) for k in (1, 2, 3, 4, 5) for p in (5, 5, 7, 1_000_005, 1_000_006, None)], "l_orderkey long, l_partkey long"),
    )


def test_known_edges_are_distinct(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 3), (3, 1), (2, 1)], "from long, to long")
    assert sorted(tuple(r) for r in graph.known_edges(nodes, edges).collect()) == [(1, 2), (2, 1)]


def test_numbers_of_events(spark, tmp_path):
    ids = [0, 999, 1000, 1007, 999_999, 1_000_000, 1_234_567, 5_999_999, 1_234_567_890, 2**62 + 1, -5, -5000, None]
    rows = [(k, datetime.datetime(2024, 1, 1, 23, 59, 59)) for k in ids] + [(7, None)]
    checked(spark, tmp_path, "shown_events", events=(rows, "event_id long, ts timestamp_ntz"))
