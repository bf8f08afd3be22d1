"""Versions and their pointer, canonical JSON, journals, outside batches, and streams of claims and rates."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import catalog, journal
from tessella.streaming import searches


def test_canonical_json_has_keys_in_order(spark):
    df = spark.sql("select named_struct('z', 1, 'a', array(named_struct('y', 2, 'b', cast(null as int)))) as s, 'x' as a, cast(null as string) as n")
    assert journal.canonical(df).first().json == '{"a":"x","s":{"a":[{"y":2}],"z":1}}'


def test_pointer_follows_whole_versions(spark, tmp_path):
    path, rows = str(tmp_path / "events"), spark.createDataFrame([("a",)], "id string")
    journal.publish(rows, path, "1")
    journal.publish(rows.union(rows), path, "2")
    assert journal.current(spark, path, "id string").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        journal.publish(rows, path, "2")
    catalog.write(rows, path, "3")  # written, but not published
    assert journal.current(spark, path, "id string").count() == 2


def test_journal_and_report(spark, tmp_path):
    counts = spark.createDataFrame([("created", 2), ("skipped", 1)], "outcome string, n long")
    for run in ("r1", "r2"):
        journal.record({"run": run, "sources": 3}, counts, str(tmp_path / "journal"))
    assert spark.read.json(str(tmp_path / "journal")).groupBy("run").agg(F.sum("n").alias("n")).where("n = 3").count() == 2
    journal.report(spark.createDataFrame([("b", "warning", "1", ""), ("a", "error", "2", "")], "code string, severity string, path string, message string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_outside_batches(spark, tmp_path):
    good = {"schemaVersion": 1, "observations": [{"source": {"url": "u"}, "event": {"title": "T", "occurrences": [{"date": "2027-01-01"}]}}], "windowMonthsSearched": ["2027-01", "2027-02"]}
    for name, body in (("a", json.dumps(good)), ("b", "no"), ("c", json.dumps({"schemaVersion": 1, "observations": []})), ("d", json.dumps(good | {"schemaVersion": 2}))):
        (tmp_path / f"{name}.json").write_text(body)
    got = {r.file: (r.problem, r.event and r.event.title) for r in journal.observations(spark, str(tmp_path)).collect()}
    assert got == {"a.json": (None, "T"), "b.json": ("invalid-json", None), "c.json": ("empty", None), "d.json": ("schema", "T")}
    assert {(r.month, r.files) for r in journal.months_searched(spark, str(tmp_path)).collect()} == {("2027-01", 2), ("2027-02", 2)}


def test_memo_reads_once(spark, tmp_path):
    (tmp_path / "venues").mkdir()
    (tmp_path / "venues" / "v1.json").write_text('{"schemaVersion": 1, "id": "v1"}')
    memo = journal.Memo(spark, str(tmp_path))
    assert memo["venues"] is memo["venues"] and memo["venues"].count() == 1
    memo.drop()
    with pytest.raises(KeyError):
        memo["nothing"]


def test_claims_and_rates_over_streams(spark, tmp_path):
    rows = [("a", "2026-01-01 10:00:00"), ("a", "2026-01-01 10:00:05"), ("b", "2026-01-01 10:00:07"), ("z", "2026-01-01 12:00:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"k": k, "ts": t}) for k, t in rows))

    def run(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return spark.table(name).collect()

    stream = spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "in"))
    assert sorted(r.k for r in run(searches.claimed_once(stream, ["k"], "ts"), "claims", "append")) == ["a", "b", "z"]
    found = run(searches.rates(stream, "k", "ts", "60 seconds", "60 seconds"), "rates", "append")
    assert {(r.k, r.n) for r in found} == {("a", 2), ("b", 1)}  # the last window isn't over
