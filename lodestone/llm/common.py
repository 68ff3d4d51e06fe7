"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: XXH64 and crc32 based hold-out rule: rows with this remainder are never learned from.
HELD_OUT_MOD, HELD_OUT_REST = 4, 2

#: What separates words in every contract of this package (fixed value).
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    A session that runs on one machine alone may do without: it gets a temporary
    folder of that machine. On a cluster that would lose data, so there it fails.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            at = found.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            import tempfile

            at = tempfile.mkdtemp(prefix="lodestone-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    ``replaces`` is an earlier result that nothing reads any more; its files go.
    What remains goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    if replaces is not None:
        forget(replaces)
    back = spark.read.schema(df.schema).parquet(path)
    back._lodestone_path = path
    return back


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def forget(*frames: DataFrame) -> None:
    """Delete the files of results of ``materialize`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestone_path", None)
        if path:
            fs, where = _files(df.sparkSession, path)
            fs.delete(where, True)


_kept: dict[str, object] = {}


def kept(name: str, make):
    """What ``make()`` gives, made once in a worker for all tasks ``releasing(..., keeps=name)``."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def drop_kept(keeps: str | None = None) -> None:
    """What tasks of other kinds have kept in this worker goes, and its memory with it."""
    others = [n for n in _kept if n != keeps]
    for name in others:
        del _kept[name]
    if others:
        give_back()


def give_back() -> None:
    """Memory that nothing uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def releasing(f, keeps: str | None = None):
    """``f`` for ``mapInArrow``, giving memory back to the system at the end: workers are used again for the next stage.

    What ``kept`` holds under other names than ``keeps`` goes at the beginning:
    idle workers are part of what an executor takes.
    """

    def run(batches):
        drop_kept(keeps)
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for an identifier and a text, null ones included; rows with one key are the same document."""
    def told(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))

    return F.unhex(F.md5(F.concat(told(doc_id), F.lit("\u0000"), told(text)).cast("binary")))


def held_out(doc_id="doc_id"):
    """True for rows that a classifier must not learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Array of the words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != "")
