"""Queries on tables whose keys go further than the given ones."""

import duckdb

from __spark_entry__ import oracle_sql
from pyspark.sql import functions as F

from tallyspark.operators.lists import sole_organizations
from tallyspark.plans.catalog import QUERIES
from tests.oracle import compare

GIVEN = "/root/testdata/sf0.001"


def test_enqueued_ids_that_are_known(spark, tmp_path):
    """Of the jobs that are added some are in the queue, as in larger tables."""
    duckdb.sql(f"copy (select * replace (event_id + i * 5000000 as event_id) from '{GIVEN}/events.parquet', (values (0), (1)) v(i) where i = 0 or event_id % 300 = 0) to '{tmp_path}/events.parquet' (format parquet)")
    assert compare(spark, str(tmp_path), "queue_enqueue", QUERIES["queue_enqueue"], oracle_sql()["queue_enqueue"]) == ""


def test_sole_members_without_meeting_of_members(spark):
    rows = [(1, 2), (1, 2), (2, 4), (2, 5), (3, 7), (4, 8), (4, None), (5, None), (None, 2), (None, 4), (6, 4), (6, 6)]
    frame = spark.createDataFrame(rows, "org long, user_id long")
    found = sole_organizations(frame, F.col("user_id") % 2 == 0)
    assert sorted((r.org for r in found.collect()), key=str) == [1, 4, None]
    assert "Join" not in found._jdf.queryExecution().sparkPlan().toString()
