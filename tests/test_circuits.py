"""A host's circuit over a table and over a stream that arrives in disorder."""

import random
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.operators import circuits
from tessella.streaming import circuits as stream_circuits

RULE = circuits.Rule(least=3, pauses=(10_000_000, 30_000_000))
SCHEMA = "host string, ts timestamp, url string, ok boolean"


def test_steps():
    c, said = circuits.Circuit(), []
    for second, url, ok in [(0, "a", False), (1, "a", False), (2, "b", False), (3, "c", True), (4, "a", False), (5, "b", False), (6, "c", False), (7, "d", True), (15, "d", True), (16, "e", False), (17, "e", False), (18, "f", True)]:
        said.append((c.step(RULE, second * 1_000_000, url, ok), c.open_until // 1_000_000, c.level))
    assert said == [("sent", -1, 0)] * 6 + [("sent", 16, 0), ("refused", 16, 0), ("refused", 16, 0), ("probe", 46, 1), ("refused", 46, 1), ("refused", 46, 1)]
    assert c.step(RULE, 46_000_000, "g", True) == "probe" and c.open_until == -1 and c.level == 0


def log(n=400):
    r, start = random.Random(3), datetime(2027, 1, 1)
    return [(r.choice(["h1", "h1", "h2"]), start + timedelta(seconds=r.randrange(900), milliseconds=r.randrange(3)), f"u{r.randrange(9)}", r.random() < 0.35) for _ in range(n)]


def test_a_stream_agrees_with_the_table(spark):
    rows = log()
    table = spark.createDataFrame([*rows, (None, rows[0][1], "x", True)], SCHEMA)
    want = sorted(map(tuple, circuits.decisions(table, "host", "ts", "url", "ok", RULE).collect()))
    assert len(want) == len(rows) and {w[4] for w in want} == {"sent", "refused", "probe"}
    source, out, check = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    # in disorder, in five batches, then one request long after all others
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    for i in range(5):
        spark.createDataFrame(shuffled[i::5], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("end", datetime(2027, 2, 1), "z", True)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    for k, v in stream_circuits.STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream_circuits.decisions(stream, "host", "ts", "url", "ok", RULE, late="1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        for k in stream_circuits.STORE:
            spark.conf.unset(k)
    got = sorted(map(tuple, spark.read.schema(circuits.COLUMNS).parquet(out).where(F.col("host") != "end").collect()))
    assert got == want
