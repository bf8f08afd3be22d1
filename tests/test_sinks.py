"""Written files: calendars, site maps and sheets."""

import csv
import tempfile
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from tessella.operators import sinks


def test_a_calendar_file_is_written_as_it_is(spark):
    rows = spark.createDataFrame([("a", date(2027, 7, 1), "20:00", "Música, de; cámara " * 6, "scheduled"), ("b", date(2027, 1, 1), None, "Sólo", "cancelled")], "u string, d date, t string, title string, s string")
    doc = sinks.calendar(F.col("u"), F.col("d"), F.col("t"), F.col("title"), F.lit(None).cast("string"), F.lit(""), F.lit("https://x.example"), F.col("d"), F.col("s"))
    target = f"{tempfile.mkdtemp(prefix='spark-')}/ics"
    sinks.write_documents(rows.select("u", doc.alias("text")), target, "u", "text")
    told = {p.parent.name: p.read_bytes().decode() for p in Path(target).glob("u=*/part-*")}
    a, b = told["u=a"], told["u=b"]
    lines = a.rstrip("\n").split("\r\n")
    assert "DTSTART:20270701T180000Z" in lines and lines[0] == "BEGIN:VCALENDAR" and all(len(x.encode()) <= 75 for x in lines)
    assert "".join(x[1:] if x.startswith(" ") else "\n" + x for x in lines).split("\nSUMMARY:")[1].split("\n")[0] == "Música\\, de\\; cámara " * 6
    assert "DTSTART;VALUE=DATE:20270101\r\n" in b and "STATUS:CANCELLED\r\n" in b and "LOCATION" not in b


def test_site_maps_are_whole_and_in_order(spark):
    pages = spark.createDataFrame([(f"p{i:03d}?a&b",) for i in range(25)], "path string")
    target = f"{tempfile.mkdtemp(prefix='spark-')}/maps"
    sinks.write_lines(sinks.site_maps(pages, "https://x.example/", "path", most=10), target)
    files = {p.parent.name: p.read_text().splitlines() for p in Path(target).glob("file=*/part-*")}
    assert {k: len(v) for k, v in files.items()} == {"file=0": 12, "file=1": 12, "file=2": 7}
    assert files["file=1"][1] == "<url><loc>https://x.example/p010?a&amp;b</loc></url>" and all(v[0].startswith("<?xml") and v[-1] == "</urlset>" for v in files.values())


def test_sheets(spark):
    target = tempfile.mkdtemp(prefix="spark-")
    sinks.sheets({"events": spark.createDataFrame([(1, ["a", "b"], "x, y")], "id int, names array<string>, t string").coalesce(1)}, target)
    assert list(csv.reader(next(Path(target).glob("events/part-*")).open())) == [["id", "names", "t"], ["1", "a; b", "x, y"]]
