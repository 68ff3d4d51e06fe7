"""Sinks: result tables, compacted results, CSV files, manifests and content-addressed artifacts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.evaluation import question_order, reconcile
from lodestone.session import stored


def append_results(rows: DataFrame, path: str) -> None:
    """Durable append: Spark commits all rows or none."""
    rows.write.mode("append").json(path)


def valid_result(error: Column, key: Column, answer: Column) -> Column:
    return (F.trim(key) != "") & error.isNull() & (F.trim(answer) != "")


def compact_results(rows: DataFrame, path: str, key: str = "question_id", sequence: str = "write_seq") -> DataFrame:
    """Write the last valid row of each key, sorted, and give it back. Compacting again changes nothing."""
    ok = valid_result(F.col("error"), F.col(key), F.col("generated_answer"))
    done = reconcile(rows, key, sequence, ok).orderBy(*question_order(F.col(key)))
    done.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's classes, the file system of a path, and the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _move(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """Rename a file in one step. With ``overwrite`` a file at the target is replaced, and there is one at any time; without, it is an error."""
    hadoop, fs, at = _hadoop(spark, source)
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if overwrite else rename.NONE
    hadoop.FileContext.getFileContext(at.toUri(), fs.getConf()).rename(fs.makeQualified(at), fs.makeQualified(hadoop.Path(target)), how)


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    """A small file that readers see whole or not at all."""
    beside = f"{path}.{uuid.uuid4().hex}.next"
    _, fs, at = _hadoop(spark, beside)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        _move(spark, beside, path, overwrite)
    except Exception:
        fs.delete(at, False)
        raise


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """One file with only the listed fields, in this order, with a header; it replaces an earlier one in one step.

    For reports that a person opens: one task writes it. Fields that the rows
    don't have are empty.
    """
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.next"
    listed = rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])
    listed.coalesce(1).write.option("header", True).csv(beside)
    _, fs, at = _hadoop(spark, beside)
    parts = [str(f.getPath()) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")]
    if parts:
        _move(spark, parts[0], path, True)
    else:  # no row: only the header
        _write_text(spark, path, ",".join(fields) + "\n", True)
    fs.delete(at, True)


# ---- tables in buckets ----


def _state(spark: SparkSession, path: str) -> dict:
    """The newest version of a table of buckets: its number, its buckets, and for each the folder and the fingerprint it was made from."""
    _, fs, at = _hadoop(spark, f"{path.rstrip('/')}/versions")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []
    if not names:
        return {"version": 0, "buckets": None, "schema": None, "folders": {}, "prints": {}}
    return json.loads(spark.read.text(f"{path.rstrip('/')}/versions/{names[-1]}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Add a version; an error if another writer has added it since this one read the last."""
    _, fs, at = _hadoop(spark, f"{path.rstrip('/')}/versions")
    fs.mkdirs(at)
    _write_text(spark, f"{path.rstrip('/')}/versions/{state['version']:09d}.json", json.dumps(state, sort_keys=True), False)


def _placed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write_folders(rows: DataFrame, path: str) -> dict[str, str]:
    """Write rows with their ``bucket`` into a new folder; where each bucket lies. A bucket is as many files as Spark's writers make of it."""
    at = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(at)
    _, fs, where = _hadoop(rows.sparkSession, at)
    return {f.getPath().getName().split("=")[1]: f"{at}/{f.getPath().getName()}" for f in fs.listStatus(where) if "=" in f.getPath().getName()}


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A table in folders by a hash of its key, which ``upsert`` and ``refresh`` replace one by one. An earlier table there becomes an older version."""
    spark = rows.sparkSession
    state = {"version": _state(spark, path)["version"] + 1, "buckets": buckets, "schema": rows.schema.json(), "folders": _write_folders(_placed(rows, key, buckets), path), "prints": {}}
    _commit(spark, path, state)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table as its newest version has it; later writes change nothing for whoever has it."""
    state = _state(spark, path)
    if not state["version"]:
        raise ValueError(f"{path}: no table of buckets")
    schema = StructType.fromJson(json.loads(state["schema"]))
    folders = list(state["folders"].values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(target: str, rows: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """Replace rows by key and add new ones, in a table of ``write_buckets``: only the buckets that rows fall in are read and written anew.

    Of rows that share a key the one with the greatest ``sequence`` stays, or
    the last in the order of the input. New folders are written beside the old
    ones and become the table by one rename: a run that dies before leaves the
    table as it was, one that another writer has overtaken is an error, and a
    reader never sees half of it. Rows with a null key are an error.
    """
    spark, state = rows.sparkSession, _state(rows.sparkSession, target)
    if not state["version"]:
        raise ValueError(f"{target}: no table of buckets")
    order = F.col(sequence) if sequence else F.monotonically_increasing_id()
    checked = rows.where(F.when(F.col(key).isNotNull(), True).otherwise(F.raise_error(F.lit(f"{key} is null")).cast("boolean")))
    ordered = checked.withColumn("_order", F.struct(order.alias("o"), F.xxhash64(*rows.columns).alias("h")))
    last = ordered.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), "_order").alias("row")).select("row.*")
    fresh = _placed(stored(last, "upsert"), key, state["buckets"])
    touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return read_buckets(spark, target)
    schema = StructType.fromJson(json.loads(state["schema"]))
    old = [state["folders"][str(b)] for b in touched if str(b) in state["folders"]]
    before = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
    merged = before.join(fresh.select(key), key, "left_anti").unionByName(fresh.drop("bucket"), allowMissingColumns=True)
    folders = state["folders"] | _write_folders(_placed(merged, key, state["buckets"]), target)
    prints = {b: p for b, p in state["prints"].items() if int(b) not in touched}
    _commit(spark, target, state | {"version": state["version"] + 1, "schema": merged.schema.json(), "folders": folders, "prints": prints})
    return read_buckets(spark, target)


def bucket_prints(rows: DataFrame, key: str, columns: list[str], buckets: int) -> dict[str, str]:
    """A fingerprint of the content of each bucket, whatever the order of its rows."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    sums = [F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in (1, 9, 17, 25)]
    found = _placed(rows, key, buckets).groupBy("bucket").agg(F.count("*").alias("n"), *sums).collect()  # at most ``buckets``
    return {str(r["bucket"]): content_name(*map(str, r[1:])) for r in found}


def root_print(prints: dict[str, str]) -> str:
    """The root over the fingerprints of all buckets: equal roots, equal tables."""
    return content_name(*(f"{b}={p}" for b, p in sorted(prints.items())))


def refresh(source: DataFrame, path: str, key: str, columns: list[str], build: Callable[[DataFrame], DataFrame], buckets: int = 64, settings: str = "") -> list[int]:
    """Bring an index of ``source`` in the folder ``path`` up to date; the buckets that were built again.

    ``build`` makes an index's rows, with the ``key``, of source rows of whole
    buckets. Fingerprints over ``columns`` and ``settings`` (what else an index
    hangs on: model, metric, parameters) tell which buckets have changed since
    they were built; only their rows are read in full, and buckets that are
    empty now go. Nothing is written if nothing has changed.
    """
    spark, state = source.sparkSession, _state(source.sparkSession, path)
    known = state["prints"] if state["buckets"] in (None, buckets) else {}
    if state["buckets"] not in (None, buckets):
        state |= {"folders": {}}
    now = {b: content_name(settings, p) for b, p in bucket_prints(source, key, columns, buckets).items()}
    if state["version"] and root_print(now) == root_print(known):
        return []
    changed = sorted(int(b) for b, p in now.items() if known.get(b) != p)
    rows = build(_placed(source, key, buckets).where(F.col("bucket").isin(changed)).drop("bucket"))
    made = _write_folders(_placed(rows, key, buckets), path) if changed else {}
    folders = {b: f for b, f in state["folders"].items() if b in now and int(b) not in changed} | made
    _commit(spark, path, {"version": state["version"] + 1, "buckets": buckets, "schema": rows.schema.json(), "folders": folders, "prints": now})
    return changed


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders and versions that the newest version doesn't have; how many folders went. Not while others read older versions or write."""
    state = _state(spark, path)
    _, fs, data = _hadoop(spark, f"{path.rstrip('/')}/data")
    used = {f.rstrip("/").split("/data/")[1] for f in state["folders"].values()}
    gone = 0
    for batch in fs.listStatus(data):
        name = batch.getPath().getName()
        for bucket in fs.listStatus(batch.getPath()):
            if "=" in bucket.getPath().getName() and f"{name}/{bucket.getPath().getName()}" not in used:
                fs.delete(bucket.getPath(), True)
                gone += 1
        if not any(u.startswith(f"{name}/") for u in used):
            fs.delete(batch.getPath(), True)
    _, fs, versions = _hadoop(spark, f"{path.rstrip('/')}/versions")
    for f in fs.listStatus(versions):
        if f.getPath().getName() != f"{state['version']:09d}.json":
            fs.delete(f.getPath(), False)
    return gone


def publish(spark: SparkSession, alias: str, path: str) -> None:
    """Point an alias, a small file, at a new index in one step: readers of ``published`` see the old one or the new one, in any session, and never none."""
    _write_text(spark, alias, path, True)


def published(spark: SparkSession, alias: str) -> DataFrame:
    """What an alias points at: a folder of Parquet or a table of buckets."""
    path = spark.read.text(alias, wholetext=True).first()[0]
    _, fs, versions = _hadoop(spark, f"{path.rstrip('/')}/versions")
    return read_buckets(spark, path) if fs.exists(versions) else spark.read.parquet(path)


def append_events(events: DataFrame, path: str, run_id: str) -> None:
    """An event log: each event with its run, its time and a JSON payload, appended."""
    rest = [c for c in events.columns if c not in ("event", "at")]
    at = F.col("at") if "at" in events.columns else F.current_timestamp()
    events.select(F.lit(run_id).alias("run_id"), at.alias("at"), "event", F.to_json(F.struct(*rest)).alias("payload") if rest else F.lit("{}").alias("payload")).write.mode("append").json(path)


def content_name(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """A key of a table's content that doesn't hang on the order of rows; one 128-bit sum is all that leaves the executors."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in (1, 9, 17, 25)]
    row = rows.agg(F.count("*").alias("n"), *parts).first()
    return content_name(*map(str, row))


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """Read the artifact of this key, or build and write it."""
    path = f"{folder.rstrip('/')}/{key}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_manifest(spark: SparkSession, path: str, fields: dict) -> None:
    """One JSON document, a file that replaces an earlier one in one step."""
    _write_text(spark, path, json.dumps(fields, sort_keys=True, default=str) + "\n", True)
