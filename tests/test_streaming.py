"""Streams: resuming after a crash, the last valid row of each question, late rows, windows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.streaming.events import LAST, RESULT, drain_windows, dropped_by_watermark, last_valid, process_incrementally

QUESTION = "question_id string, question string"


def add(spark, folder, name, rows, schema):
    """One more file for a stream: one batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/{name}")


def test_a_killed_run_asks_each_question_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in range(4):
        add(spark, src, f"b{b}", [(f"Q{3 * b + i}", "x") for i in range(3)] + [("Q0", "again")], QUESTION)
    stream = spark.readStream.schema(QUESTION).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(src)
    asked: list[str] = []
    broken = [True]

    def answer(batch):
        ids = [r.question_id for r in batch.collect()]
        if len(asked) >= 5 and broken[0]:
            raise RuntimeError("killed")
        asked.extend(ids)
        made = batch.withColumn("error", F.when(F.col("question_id") == "Q4", "down")).withColumn("generated_answer", F.lit("a"))
        return made

    with pytest.raises(Exception, match="killed"):
        process_incrementally(stream, answer, out, str(tmp_path / "cp"), key="question_id").awaitTermination()
    broken[0] = False
    process_incrementally(stream, answer, out, str(tmp_path / "cp"), key="question_id").awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r.question_id for r in rows.collect()) == sorted(f"Q{i}" for i in range(12))
    assert sorted(asked) == sorted(f"Q{i}" for i in range(12))
    # a new run with a new checkpoint asks only what has no valid answer
    asked.clear()
    process_incrementally(stream, answer, f"{out}", str(tmp_path / "cp2"), key="question_id").awaitTermination()
    assert set(asked) == {"Q4"}


def test_last_valid_row_and_late_ones(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    t0 = datetime(2024, 1, 1)
    at = lambda minutes: t0 + timedelta(minutes=minutes)
    batches = [
        [("Q1", at(0), 1, None, "one"), ("Q1", at(1), 2, "err", ""), ("Q2", at(0), 1, None, " "), ("Q3", at(2), 1, None, "three")],
        [("Q1", at(5), 3, None, "two"), ("Q1", at(3), 2, None, "between"), ("Q2", at(4), 2, None, "valid")],
        [("Q1", at(4), 9, None, "late"), ("Q3", at(1), 0, None, "late too"), ("Q9", at(600), 1, None, "far on")],
        [("Q1", at(6), 10, None, "before the watermark"), ("Q8", at(601), 1, None, "on time")],
        [("Q3", at(602), 5, None, "after expiry")],
    ]
    for b, rows in enumerate(batches):
        add(spark, src, f"b{b}", rows, RESULT)
        stream = spark.readStream.schema(RESULT).option("recursiveFileLookup", True).json(src)
        q = last_valid(stream, "30 minutes", 60 * 60 * 1000).writeStream.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(lambda df, e: df.write.mode("overwrite").parquet(f"{out}/epoch={e}")).start()
        q.awaitTermination()  # every batch is a run of its own that resumes the one before
        if b == 3:
            assert dropped_by_watermark(q) == 1
    got = spark.read.schema(LAST).parquet(out).orderBy("ts", "write_seq").collect()
    held = [(r.question_id, r.generated_answer, r.first) for r in got if r.kind == "held"]
    assert sorted(held) == sorted([("Q1", "one", True), ("Q3", "three", True), ("Q1", "two", False), ("Q2", "valid", True), ("Q9", "far on", True), ("Q8", "on time", True), ("Q3", "after expiry", True)])
    assert sorted((r.question_id, r.generated_answer) for r in got if r.kind == "late") == [("Q1", "late"), ("Q3", "late too")]


def test_windows_drop_what_is_late(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double"
    src = str(tmp_path / "in")
    t0 = datetime(2024, 1, 1)
    add(spark, src, "b0", [("a", t0, 1.0), ("a", t0 + timedelta(hours=9), 2.0)], schema)
    add(spark, src, "b1", [("a", t0 + timedelta(hours=9, minutes=1), 3.0)], schema)  # the watermark acts on what comes after the next batch
    add(spark, src, "b2", [("a", t0 + timedelta(minutes=5), 100.0)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(src)
    rows, q = drain_windows(stream, at=str(tmp_path / "out"))
    assert sorted((r.hour.hour, r.n, r.total) for r in rows.collect()) == [(0, 1, 1.0), (9, 2, 5.0)]
    assert dropped_by_watermark(q) == 1
