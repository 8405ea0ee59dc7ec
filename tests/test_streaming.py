"""Streams over several batches: late and repeated rows, state that goes when its time is over."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from fieldwarden.streaming import jobs


def stream(spark, path, schema, batches):
    """A file a batch; an empty batch keeps the other streams in step."""
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.select(*[F.to_timestamp(c).alias(c) if c == "time" else F.col(c) for c in df.columns]).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    kinds = ", ".join(f"{c.split()[0]} timestamp" if c.startswith("time ") else c for c in schema.split(", "))
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path)


def t(hour, minute=0):
    return f"2024-01-0{1 + hour // 24} {hour % 24:02d}:{minute:02d}:00"


def test_document_completion_over_batches(spark, tmp_path):
    asked = [[("whole", 3, t(0)), ("short", 2, t(0)), ("none", 1, t(0)), ("clock", 1, t(0))],
             [("tick", 1, t(5))],
             [("after", 2, t(9)), ("clock", 1, t(9))],
             [("clock2", 1, t(13))], [("clock3", 1, t(23))]]
    rows = [[("whole", "/a", t(0, 1)), ("whole", "/a", t(0, 2)), ("short", "/a", t(0, 3)), ("stranger", "/x", t(0, 1)), ("early", "/a", t(0, 2)),
             ("after", "/a", t(0, 50))],
            # A field again, the last one of a document, a field after the deadline.
            [("whole", "/a", t(4, 10)), ("whole", "/b", t(4, 11)), ("whole", "/c", t(4, 12)), ("short", "/b", t(8)), ("after", "/a", t(8, 30))],
            # The deadline of "short" is over; a decided document stays decided.
            [("whole", "/d", t(9)), ("after", "/b", t(9, 30)), ("tick", "/a", t(9))],
            # In time, but it comes after the verdict.
            [("short", "/b", t(1)), ("clock2", "/a", t(13))], [("clock3", "/a", t(23))]]
    requests = stream(spark, str(tmp_path / "asked"), "document_id string, expected_fields int, time string", asked)
    arrivals = stream(spark, str(tmp_path / "rows"), "document_id string, field_id string, time string", rows)
    verdicts = jobs.completion(arrivals, requests, wait="6 hours", late="30 minutes", keep="2 hours")
    got = {r.document_id: (r.state, r.arrived_fields, r.expected_fields) for r in jobs.run_available(verdicts, "completion").collect()}
    assert got["whole"] == ("complete", 3, 3) and got["after"] == ("complete", 2, 2) and got["tick"] == ("complete", 1, 1)
    assert got["short"] == ("incomplete", 1, 2) and got["none"] == ("incomplete", 0, 1)
    assert got["stranger"] == ("unexpected", 1, None) and got["early"] == ("unexpected", 1, None)
    assert got["clock2"] == ("complete", 1, 1)


def test_state_is_kept_per_field_and_goes(spark, tmp_path):
    rows = [[("d", f"/{i}", t(0, 1)) for i in range(20)], [("d", "/20", t(0, 5))], [("other", "/a", t(8))], [("other", "/b", t(20))], [("other2", "/c", t(21))]]
    asked = [[("d", 30, t(0))], [("x", 9, t(0, 5))], [("y", 1, t(8))], [("z", 1, t(20))], [("q", 1, t(21))]]
    requests = stream(spark, str(tmp_path / "asked"), "document_id string, expected_fields int, time string", asked)
    arrivals = stream(spark, str(tmp_path / "rows"), "document_id string, field_id string, time string", rows)
    marks = str(tmp_path / "marks")
    verdicts = jobs.completion(arrivals, requests, wait="2 hours", late="10 minutes", keep="3 hours")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = (verdicts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", marks)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()

    def fields(batch):
        state = spark.read.format("statestore").option("path", marks).option("stateVarName", "fields").option("batchId", batch).load()
        return {(r.key[0], r.user_map_key[0]) for r in state.select("key", F.col("user_map_key")).collect()}

    assert {f for d, f in fields(0) if d == "d"} == {f"/{i}" for i in range(20)}
    assert {f for d, f in fields(1) if d == "d"} == {f"/{i}" for i in range(21)}
    last = max(p["batchId"] for p in query.recentProgress)
    assert not [d for d, _ in fields(last) if d == "d"]
    records = spark.read.format("statestore").option("path", marks).option("stateVarName", "record").option("batchId", last).load()
    assert not [r for r in records.select("key").collect() if r.key[0] in ("d", "x")]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in out.filter("document_id = 'd'").collect()] == [("d", "incomplete", 21, 30)]


def test_scorecard_and_ingestion_over_batches(spark, tmp_path):
    schema = "document_id string, field_id string, model string, time string"
    batches = [[("d", "/a", "m", t(0, 1)), ("d", "/a", "m", t(0, 1)), ("d", "/b", "m", t(0, 30))],
               [("d", "/a", "m", t(1, 30)), ("e", "/a", "n", t(2, 30))],
               [("h", "/a", "m", t(2, 35))],
               [("late", "/a", "m", t(0, 40)), ("d", "/b", "m", t(2, 31)), ("f", "/a", "m", t(2, 10))],
               [("g", "/a", "m", t(9))]]
    rows = stream(spark, str(tmp_path / "in"), schema, batches)
    full = rows.select("*", F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("infer"), F.lit(5).alias("generated_tokens"), F.lit(2.0).alias("decode"))
    card = {(str(r.window_start)[11:13], r.model): r.requests for r in jobs.run_available(jobs.scorecard(full), "card").collect()}
    # The row of 00:40 came when its hour was over and is dropped; the one of 02:10 is late too, but its hour is open.
    assert card == {("00", "m"): 3, ("01", "m"): 1, ("02", "m"): 3, ("02", "n"): 1}
    once = jobs.run_available(jobs.ingested_once(rows, late="30 minutes"), "once")
    got = sorted((r.document_id, r.field_id, str(r.time)[11:16]) for r in once.collect())
    # Repeats are dropped across batches until the watermark has passed the key; what is later is a new delivery, what is older is too late.
    assert got == [("d", "/a", "00:01"), ("d", "/b", "00:30"), ("d", "/b", "02:31"), ("e", "/a", "02:30"), ("f", "/a", "02:10"), ("g", "/a", "09:00"),
                   ("h", "/a", "02:35")]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_completes_at_once_leaves_no_fields(spark, tmp_path):
    rows = [[("d", "/a", t(0, 1)), ("d", "/a", t(0, 2)), ("d", "/b", t(0, 3)), ("e", "/a", t(0, 1))], [("f", "/a", t(1))]]
    requests = stream(spark, str(tmp_path / "asked"), "document_id string, expected_fields int, time string", [[("d", 2, t(0)), ("e", 2, t(0))], [("g", 1, t(1))]])
    arrivals = stream(spark, str(tmp_path / "rows"), "document_id string, field_id string, time string", rows)
    marks = str(tmp_path / "marks")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = (jobs.completion(arrivals, requests, wait="6 hours", late="30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in out.collect()] == [("d", "complete", 2, 2)]
    first = spark.read.format("statestore").option("path", marks).option("stateVarName", "fields").option("batchId", 0).load()
    assert {(r.key[0], r.user_map_key[0]) for r in first.collect()} == {("e", "/a")}


def test_copies_and_fields_after_the_deadline_are_not_kept(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"d": "x", "f": f, "t": n} for f, n in (("/a", 1), ("/a", 1), (None, 1), ("/a", 2), (None, 1))])
    (left,) = jobs.without_copies([batch])
    assert left.schema == batch.schema and left.to_pylist() == [{"d": "x", "f": f, "t": n} for f, n in (("/a", 1), (None, 1), ("/a", 2))]
    # "/b" comes after the deadline of its document, and never counts.
    rows = [[("d", "/a", t(0, 1)), ("d", "/b", t(3))], [("other", "/a", t(2))], [("end", "/a", t(8))], [("last", "/a", t(9))]]
    asked = [[("d", 3, t(0))], [("x", 1, t(2))], [("y", 1, t(8))], [("z", 1, t(9))]]
    requests = stream(spark, str(tmp_path / "asked"), "document_id string, expected_fields int, time string", asked)
    arrivals = stream(spark, str(tmp_path / "rows"), "document_id string, field_id string, time string", rows)
    marks = str(tmp_path / "marks")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = (jobs.completion(arrivals, requests, wait="2 hours", late="4 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    kept = spark.read.format("statestore").option("path", marks).option("stateVarName", "fields").option("batchId", 0).load()
    assert {(r.key[0], r.user_map_key[0]) for r in kept.collect()} == {("d", "/a")}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in out.filter("document_id = 'd'").collect()] == [("d", "incomplete", 1, 3)]
