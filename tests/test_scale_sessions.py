"""Merged sessions, calendars and reports: one deal of the rows, in as many partitions as asked for, and results on odd rows."""

from datetime import date

from pyspark.sql import functions as F

from tessella.operators import calendars, quality, reconcile
from tessella.sources.storage import dealt, parts_for

DAY, NEXT = date(2027, 3, 1), date(2027, 3, 8)
P, N = "k int, ident string, day date, clock string", "k int, day date, clock string"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_merge_deals_once(spark):
    p = spark.createDataFrame([(1, "a", DAY, "20:00"), (1, "a", DAY, "20:00"), (2, "b", DAY, None), (3, "c", DAY, None), (3, "d", DAY, None), (4, "e", None, None), (5, "f", None, "20:00")], P)
    n = spark.createDataFrame([(1, DAY, "20:00"), (2, DAY, "19:00"), (2, DAY, "19:00"), (3, DAY, "18:00"), (5, None, "20:00"), (6, DAY, None), (7, DAY, None), (7, DAY, "20:00")], N)
    out = reconcile.merge_occurrences(p, n, "k", "day", "clock", "ident", parts=7)
    assert exchanges(out) == 1 and out.rdd.getNumPartitions() == 7
    want = [(1, "a", DAY, "20:00", "exact"), (2, "b", DAY, "19:00", "refined"), (3, "c", DAY, None, "kept"), (3, "d", DAY, None, "kept"), (3, None, DAY, "18:00", "new"), (5, "f", None, "20:00", "kept"), (6, None, DAY, None, "new"), (7, None, DAY, None, "new"), (7, None, DAY, "20:00", "new")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_a_repeated_session_is_one(spark):
    p = spark.createDataFrame([(1, "a", DAY, "20:00"), (1, "a", DAY, "20:00"), (2, "b", DAY, None), (3, "c", DAY, None)], "k int, ident string, date date, time string")
    n = spark.createDataFrame([(1, NEXT, None), (1, NEXT, None), (2, NEXT, "19:00"), (3, NEXT, "19:00"), (3, NEXT, "20:00")], "k int, date date, time string")
    status = spark.createDataFrame([(1, "postponed", "scheduled"), (2, "scheduled", "cancelled"), (3, "postponed", "postponed")], "k int, was string, now string")
    out = calendars.merged(p, n, status, "k", "ident", parts=5)
    assert out.rdd.getNumPartitions() == 5
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(1, "a", NEXT, None, "moved", "scheduled"), (2, "b", DAY, None, "kept", "cancelled"), (2, None, NEXT, "19:00", "new", "scheduled"), (3, "c", DAY, None, "kept", "scheduled"), (3, None, NEXT, "19:00", "new", "scheduled"), (3, None, NEXT, "20:00", "new", "scheduled")]
    assert got == sorted(want, key=str)


def test_calendar_plan_deals_once(spark):
    third, far = date(2027, 3, 15), date(2027, 6, 1)
    p = spark.createDataFrame([(1, "a", DAY), (2, "b", DAY), (2, "c", NEXT), (3, "d", DAY), (4, "e", DAY), (4, "f", DAY), (5, "g", DAY), (5, "h", far)], "k int, ident string, day date")
    q = spark.createDataFrame([(1, NEXT), (1, third), (1, third), (2, third), (3, NEXT), (5, NEXT)], "k int, day date").distinct()
    moves = spark.createDataFrame([(1, DAY, NEXT), (1, DAY, NEXT), (2, DAY, third), (2, NEXT, third), (3, third, NEXT), (5, None, NEXT)], "k int, from date, to date")
    scopes = spark.createDataFrame([(3, DAY, DAY), (5, date(2027, 2, 1), NEXT), (5, DAY, third)], "k int, first date, last date")
    out = reconcile.calendar_plan(p, q, moves, scopes, "k", "ident", "day", "2027-01-01", parts=6)
    assert exchanges(out) - exchanges(q) == 1 and out.rdd.getNumPartitions() == 6
    want = [(1, "a", NEXT, "moved"), (1, None, third, "new"), (2, "b", DAY, "review"), (2, "c", NEXT, "review"), (3, "d", DAY, "dropped"), (3, None, NEXT, "new"), (4, "e", DAY, "review"), (4, "f", DAY, "review"), (5, "g", DAY, "dropped"), (5, "h", far, "kept"), (5, None, NEXT, "new")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_calendar_with_times_deals_by_rows(spark):
    p = spark.createDataFrame([(1, "a", DAY, "20:00")], "k int, ident string, date date, time string")
    n = spark.createDataFrame([(1, NEXT, None)], "k int, date date, time string")
    moves = spark.createDataFrame([], "k int, order int, from_date date, from_time string, to_date date, to_time string")
    scopes = spark.createDataFrame([], "k int, first date, last date")
    out = calendars.planned(p, n, moves, scopes, "k", "ident", "2027-01-01", parts=9)
    assert out.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", DAY, "20:00", "kept", None), (1, None, NEXT, None, "new", 2)], key=str)


def test_report_counts_issues_where_they_are(spark):
    bad = spark.createDataFrame([("x", "error", "2"), ("x", "error", "10"), ("y", "warning", "3")], "code string, severity string, path string")
    assert sorted(map(tuple, quality.report(bad).collect())) == [("x", "error", 2, "10", False), ("y", "warning", 1, "3", False)]
    assert [r.passes for r in quality.report(bad.where("severity = 'warning'")).collect()] == [True]
    quality.report(bad.withColumn("path", F.raise_error(F.lit("issues were written out"))))  # nothing runs before the report is asked for


def test_rows_ask_for_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    assert (parts_for(df), parts_for(df, 10)) == (4, 101)
    assert dealt(df, 9, "k").groupBy("k", "id").count().rdd.getNumPartitions() == 9
