"""Live scorecard, review queue, exactly-once ingestion, document completion, log follow and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.numbers import count_if, ratio
from ..operators.policy import mandatory, review_reason
from ..session import scratch_path


def scorecard(requests: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests, failures, mean latency and token rate per model and window; rows later than ``late`` are dropped."""
    windows = F.window("time", size, slide) if slide else F.window("time", size)
    return (requests.withWatermark("time", late).groupBy(windows.alias("w"), "model").agg(
        F.count("*").alias("requests"), count_if(F.col("error").isNotNull()).alias("failed"),
        F.sum("infer").alias("infer_seconds"), F.max("infer").alias("max_infer_s"),
        ratio(F.sum("generated_tokens"), F.sum("decode")).alias("tokens_per_s"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "model", "requests", "failed",
                "infer_seconds", "max_infer_s", "tokens_per_s"))


def live_queue(rows: DataFrame, threshold: float, supported: DataFrame | None = None, rules: DataFrame | None = None,
               text: str = "prediction") -> DataFrame:
    """Review queue of arriving rows under a frozen policy: stream-static joins, no state.

    An empty list of supported fields restricts nothing, as in a batch.
    """
    from ..operators.policy import with_support
    from ..operators.shapes import flag_rows

    if rules is not None:
        rows = flag_rows(rows, rules, text)
    rows = with_support(rows, supported)
    marked = rows.withColumn("mandatory", mandatory()).withColumn(
        "needs_review", F.col("mandatory") | (F.col("score") < threshold)).withColumn("reason", review_reason())
    priority = F.when(F.col("reason") == "low_correctness_confidence", 1 - F.col("score")).otherwise(1.0)
    return marked.filter(F.col("reason").isNotNull()).withColumn("priority", priority)


def ingested_once(rows: DataFrame, time: str = "time", late: str = "1 hour") -> DataFrame:
    """Every (document, field) once, however often it is delivered within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["document_id", "field_id"])


def completion(rows: DataFrame, requests: DataFrame, time: str = "time", wait: str = "30 minutes", late: str = "1 hour",
               keep: str = "365 days") -> DataFrame:
    """One verdict per document: ``document_id, state, arrived_fields, expected_fields``.

    ``rows`` is a stream of ``document_id, field_id`` and ``requests`` one of
    ``document_id, expected_fields``, both with the event time. A document is
    ``complete`` in the batch that brings its last expected field,
    ``incomplete`` when ``wait`` after its request has passed, also without
    any row, and ``unexpected`` when that long after its first row no request
    came. A field counts once however often it is delivered, and not beyond
    the deadline. Later rows of a document change nothing: a mark of the
    verdict stays for ``keep`` after the deadline. Of several requests of a
    document the earliest of the first batch that has one counts.
    """
    arrivals = rows.select(F.col("document_id").cast("string").alias("document_id"), F.col("field_id").cast("string").alias("field_id"),
                           F.lit(None).cast("long").alias("expected"), F.col(time).alias("time"))
    asked = requests.select(F.col("document_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("field_id"),
                            F.col("expected_fields").cast("long").alias("expected"), F.col(time).alias("time"))
    # Copies of a delivery are one row before they travel. One watermark over both: the requests may all be older than the rows.
    arrivals = arrivals.mapInArrow(without_copies, arrivals.schema)
    events = arrivals.unionByName(asked).withColumn("at", F.col("time").cast("double"))
    processor = Verdicts(*(pd.Timedelta(d).total_seconds() for d in (wait, keep)))
    return events.withWatermark("time", late).groupBy("document_id").transformWithState(
        processor, "document_id string, state string, arrived_fields long, expected_fields long", "Append", "EventTime")


def without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows of every batch."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).select(batch.schema.names).to_batches()


class Verdicts(StatefulProcessor):
    """State of one document: a small record, and a map from field to its first time.

    A batch reads and writes the fields it brings, not those that came before.
    The record counts the fields that are in time, so nothing is listed but
    once, when the request comes after fields; a field after a known deadline is not kept. With the verdict the fields
    go; the record follows when its timer is over. Every access to the state
    is a message to the JVM, so nothing is asked for twice.
    """

    def __init__(self, wait: float, keep: float):
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "expected long, deadline double, arrived long, done boolean, timer long")
        self.fields = handle.getMapState("fields", "field_id string", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.record.get()
        expected, deadline, arrived, done, timer = stored if stored is not None else (None, None, 0, False, None)
        if done:
            return
        first: dict[str, float] = {}
        requests: list[tuple[float, int]] = []
        for row in rows:
            name, asked, at = row.field_id, row.expected, float("nan") if row.at is None else row.at
            if asked is not None:
                requests.append((at, asked))
            if name is not None:
                known = first.get(name)
                if known is None or known != known or at < known:
                    first[name] = at
        fresh = expected is None and requests
        if fresh:
            at, expected = min(requests)
            deadline = at + self.wait
        elif expected is None and first:
            deadline = min(x for x in (deadline, min(first.values()) + self.wait) if x is not None)
        if stored is None and expected is not None:
            # Nothing is stored of the document: what this batch completes leaves no fields behind.
            arrived = sum(at <= deadline for at in first.values())
            if arrived >= expected:
                yield self._verdict(key, "complete", expected, expected, deadline, timer, timerValues, False)
                return
        for name, at in first.items():
            found = self.fields.getValue((name,)) if stored is not None else None
            known = found[0] if found is not None else float("inf")
            if at < known and (expected is None or at <= deadline):
                self.fields.updateValue((name,), (at,))
                if expected is not None and not fresh:
                    arrived += known > deadline >= at
        if fresh and stored is not None:
            arrived = sum(value[0] <= deadline for _, value in self.fields.iterator())
            if not arrived:
                self.fields.clear()
        if expected is not None and arrived >= expected:
            yield self._verdict(key, "complete", expected, expected, deadline, timer, timerValues, True)
            return
        timer = self._timer(timer, deadline, timerValues)
        self.record.update((expected, deadline, arrived, False, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expected, deadline, arrived, done, timer = self.record.get()
        if done:
            self.record.clear()
            return
        if expected is None:
            arrived = sum(value[0] <= deadline for _, value in self.fields.iterator())
        yield self._verdict(key, "unexpected" if expected is None else "incomplete", arrived, expected, deadline, None, timerValues,
                            expected is None or arrived > 0)

    def _timer(self, old: int | None, until: float, timerValues) -> int:
        new = max(int(until * 1000), timerValues.getCurrentWatermarkInMs() + 1)
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return new

    def _verdict(self, key, state, arrived, expected, deadline, timer, timerValues, has_fields) -> Row:
        if has_fields:
            self.fields.clear()
        timer = self._timer(timer, deadline + self.keep, timerValues)
        self.record.update((expected, deadline, arrived, True, timer))
        return Row(document_id=key[0], state=state, arrived_fields=arrived, expected_fields=expected)

    def close(self) -> None:
        pass


def log_follow(records: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean value and record count per split and window of a training or monitor log."""
    return (records.withWatermark("time", late).groupBy(F.window("time", size).alias("w"), "split").agg(
        F.count("*").alias("records"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
        .select(F.col("w.start").alias("window_start"), "split", "records", "total", "mean"))


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Requests of one user with no pause longer than ``gap`` between them."""
    return (requests.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("w"), "user_id").agg(
        F.count("*").alias("requests"), F.sum("generated_tokens").alias("tokens"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests", "tokens"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is into a Parquet table of the shared folder, and read the table.

    The stream stays open in the sense of append mode: windows and documents
    whose time is not over at the last watermark are in its state, not in the
    table, and come out when more input moves the watermark.
    """
    spark = stream.sparkSession
    # Sessions of one user are merged inside each task before they are shuffled to its state.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    # Keyed state lives on disk beside the task, in files of the changes only.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
