"""Incremental processing: questions are answered as they arrive, each once, and runs resume after a crash.

Windows with watermarks over the event log are an extension.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from lodestone.session import scratch_dir
from lodestone.sources.sinks import valid_result

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def answered(spark: SparkSession, out: str, key: str = "question_id") -> DataFrame | None:
    """What ``process_incrementally`` has written, or None."""
    return spark.read.option("mergeSchema", True).parquet(out) if _exists(spark, out) else None


def process_incrementally(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Answer a stream of questions batch by batch; each batch is committed once, even if it is run again.

    With a ``key``, questions whose valid answer (``error``, ``generated_answer``)
    another batch has written are left out, and repeats within a batch too: a
    run that begins anew, with another checkpoint, asks only what is open.
    """

    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # epochs are those of a checkpoint

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if key:
            batch = batch.dropDuplicates([key])
            done = answered(spark, out)
            if done is not None:
                ok = valid_result(F.col("error"), F.col(key), F.col("generated_answer"))
                # a batch that runs again replaces its own rows, so these don't count
                others = (F.col("run") != run) | (F.col("epoch") != epoch)
                batch = batch.join(done.where(ok & others).select(key).distinct(), key, "left_anti")
        answer(batch).withColumn("write_seq", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/run={run}/epoch={epoch}")

    return questions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


# ---- the last valid row of each question ----

RESULT = StructType([StructField("question_id", StringType()), StructField("ts", TimestampType()), StructField("write_seq", LongType()), StructField("error", StringType()), StructField("generated_answer", StringType())])
LAST = StructType([*RESULT.fields[:3], RESULT.fields[4], StructField("kind", StringType()), StructField("first", BooleanType())])


class LastValid(StatefulProcessor):
    """Holds the last valid row of each question, and lets go of it ``expiry_ms`` after its time.

    Gives on the held row when it changes (kind ``held``; ``first`` if the
    question had none), and every row that comes after a later one was held
    (kind ``late``), so that what is late is counted apart and changes nothing.
    """

    def __init__(self, expiry_ms: int) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, write_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        valid = [r for r in rows if r.error is None and (r.generated_answer or "").strip()]
        before = self.held.get()
        last = tuple(before) if before is not None else None
        newest = None
        for r in sorted(valid, key=lambda r: (r.at, r.write_seq)):
            if last is not None and (r.at, r.write_seq) <= last:
                yield Row(question_id=key[0], ts=r.ts, write_seq=r.write_seq, generated_answer=r.generated_answer, kind="late", first=False)
            else:
                newest = r
        if newest is not None:
            self.held.update((newest.at, newest.write_seq))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest.at // 1000 + self.expiry_ms)
            yield Row(question_id=key[0], ts=newest.ts, write_seq=newest.write_seq, generated_answer=newest.generated_answer, kind="held", first=before is None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_valid(results: DataFrame, lateness: str = "1 hour", expiry_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Changes of the last valid row of each question in a stream of ``results(question_id, ts, write_seq, error, generated_answer)``.

    Rows whose time is before the watermark are dropped by Spark, which counts
    them (``dropped_by_watermark``); rows that come after a later one of their
    question, but within it, are given on as ``late``. State is one time and
    number for each question of the last ``expiry_ms``, in RocksDB.
    """
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = results.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT.fields]).where("question_id is not null and ts is not null and write_seq is not null")
    rows = rows.withColumn("at", F.unix_micros("ts"))  # times in Python may have a zone or none
    return rows.withWatermark("ts", lateness).groupBy("question_id").transformWithState(LastValid(expiry_ms), LAST, "Update", "EventTime")


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the batches that the query still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


# ---- windows of the event log ----


def windowed_events(events: DataFrame, length: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; rows of windows that end before the watermark are dropped by the stream."""
    late = events.withWatermark("ts", lateness)
    return late.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def drain_windows(events: DataFrame, lateness: str = "1 hour", at: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """All windows of what a stream has now, and the finished query.

    In update mode each batch writes only the windows that it has changed, and
    the watermark lets go of state; the last row of each window is its result.
    """
    spark, made = events.sparkSession, windowed_events(events, lateness=lateness)
    out = at or f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = made.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = StructType([*made.schema.fields, StructField("epoch", LongType())])
    rows = spark.read.schema(schema).parquet(out) if _exists(spark, out) else spark.createDataFrame([], schema)
    return rows.groupBy("hour", "event_type").agg(F.max_by("n", "epoch").alias("n"), F.max_by("total", "epoch").alias("total")), q


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain the event table through a stream, and give its windows."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows, _ = drain_windows(events)
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))
