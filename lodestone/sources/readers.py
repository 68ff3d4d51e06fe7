"""Scans of JSON lines, text folders and caches, with the checks that make a bad input an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import first_truthy

#: Fields of a questions file that would give answers away (fixed list).
FORBIDDEN = ("program_answer", "original_answer", "answer", "ground_truth_answer", "expected_answer", "context_id", "gold_context_id", "gold_context_ids")
DOCUMENT_FIELDS = "doc_key string, doc_id string, document_id string, id string, context_id string, original_context_id string, text string, context string, doc_name string, kategorie string, wissensart string, titel string, quellpfad string, sprache string, content_hash string, ingestion_version string"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line, value``: every line of text files with its number in its file, from 1.

    Files of any size are read in blocks by many tasks. A line's number is its
    place in its block and the lines of the blocks before, which are counted by
    a scan of their own. The byte order mark of a file's first line is dropped,
    and only that one; blank lines count.
    """
    # ids grow by one with each line of a task, and a block is read by one task, in order
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    lines = read.join(starts, ["file", "block"]).withColumn("line", F.col("id") + F.col("shift"))
    return lines.select("file", "line", F.when(F.col("line") == 1, F.regexp_replace("value", "^\uFEFF", "")).otherwise(F.col("value")).alias("value"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """``file, number, line, row, bad``: parsed lines, with their numbers in their files; blank ones are left out."""
    lines = numbered_lines(spark, path).select("file", F.col("line").alias("number"), F.when(F.trim("value") != "", F.col("value")).alias("line"))
    rows = lines.withColumn("row", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json("line")
    bad = whole.isNull() | (F.schema_of_variant(whole).startswith("OBJECT") == F.lit(False))
    return rows.withColumn("bad", F.col("line").isNotNull() & bad).where("line is not null")


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Rows as they are; a row that isn't ``ok`` fails the job where it is read. Rows with ``file`` and ``number`` are told by these; those with a null ``line`` are blank ones, which Spark may judge before it drops them."""
    ok = ok | F.col("line").isNull() if "line" in df.columns else ok
    said = F.concat(F.col("file"), F.lit(":"), F.col("number"), F.lit(f": {message}")) if {"file", "number"} <= {*df.columns} else F.lit(message)
    return df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(said).cast("boolean")))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``; an error if it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def read_documents(spark: SparkSession, path: str, generic: bool = False) -> DataFrame:
    """``document_id, text, original_context_id, metadata`` from a knowledge base of JSON lines; errors name file and line."""
    rows = require(json_lines(spark, path, DOCUMENT_FIELDS), ~F.col("bad"), "the line isn't a JSON object").select("file", "number", "line", "row.*")
    if generic:
        context = first_truthy(F.col("context_id"), F.col("original_context_id"))
        out = [first_truthy(F.col("document_id"), F.col("id"), context).alias("document_id"), first_truthy(F.col("context"), F.col("text")).alias("text"), context.alias("original_context_id"), F.struct(*[F.col(c) for c in ("doc_name",)]).alias("metadata")]
    else:
        key = first_truthy(F.col("doc_key"), F.col("doc_id"))
        named = F.struct("doc_id", "doc_key", "doc_name", "kategorie", "wissensart", "titel", "quellpfad", "sprache", "content_hash", "ingestion_version", F.col("doc_name").alias("file_name"), first_truthy(F.col("quellpfad"), F.col("doc_name")).alias("source_file"))
        out = [key.alias("document_id"), "text", key.alias("original_context_id"), named.alias("metadata")]
    return require(rows.select("file", "number", "line", *out), F.col("document_id").isNotNull() & (F.trim("text") != ""), "the document has no identifier or no text").drop("file", "number", "line")


def read_text_folder(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
    """Whole files; the path below the folder is the identifier, blank files are skipped."""
    files = spark.read.option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    base = path.rstrip("/") + "/"
    name = F.expr("_metadata.file_path")
    at = F.instr(name, base)
    relative = F.when(at > 0, F.substring(name, at + len(base), F.length(name))).otherwise(F.substring_index(name, "/", -1))
    return files.where(F.trim("value") != "").select(relative.alias("document_id"), F.col("value").alias("text")).orderBy("document_id")


def read_questions(spark: SparkSession, path: str, id_field: str = "question_id", question_field: str = "frage", allow_unsafe: bool = False) -> DataFrame:
    """``question_id, question``; answer-bearing fields, blanks and repeated ids are errors."""
    rows = require(json_lines(spark, path, f"`{id_field}` string, `{question_field}` string"), ~F.col("bad"), "the line isn't a JSON object")
    if not allow_unsafe:
        rows = require(rows, ~F.coalesce(F.arrays_overlap(F.json_object_keys("line"), F.array(*map(F.lit, FORBIDDEN))), F.lit(False)), "the question carries answers")
    out = rows.select("file", "number", "line", F.trim(F.col(f"row.{id_field}")).alias("question_id"), F.trim(F.col(f"row.{question_field}")).alias("question"))
    out = require(out, (F.col("question_id") != "") & (F.col("question") != ""), "the question has no id or no text")
    again = out.groupBy("question_id").agg(F.count("*").alias("n"), F.min(F.struct("file", "number", "question")).alias("first"))
    repeated = F.concat(F.col("first.file"), F.lit(":"), F.col("first.number"), F.lit(": the question id is repeated"))
    return again.where(F.when(F.col("n") == 1, True).otherwise(F.raise_error(repeated).cast("boolean"))).select("question_id", F.col("first.question").alias("question"))


def read_gold_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(question_id, chunk_id)``, trimmed and distinct; repeated questions are united."""
    rows = json_lines(spark, path, "question_id string, chunk_config_id string, gold_relevant_chunk_ids array<string>")
    rows = require(rows, ~F.col("bad") & (F.trim("row.question_id") != "") & (F.size("row.gold_relevant_chunk_ids") > 0), "the gold row is incomplete")
    return rows.select(F.trim("row.question_id").alias("question_id"), F.explode("row.gold_relevant_chunk_ids").alias("chunk_id")).select("question_id", F.trim("chunk_id").alias("chunk_id")).where("chunk_id <> ''").distinct()


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result rows of several runs, with the columns of all of them."""
    return spark.read.option("mode", "FAILFAST").json(paths)


def discover_runs(spark: SparkSession, folder: str, name: str = "summary_metrics.json", smoke: bool = False) -> DataFrame:
    """``run, path`` of run folders that hold ``name``, sorted; smoke runs are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(folder).select("path")
    run = F.element_at(F.split("path", "/"), -2)
    out = files.select(run.alias("run"), "path")
    return (out if smoke else out.where(~F.col("run").rlike("^smoke_|_smoke$"))).orderBy("run")


def read_run_summaries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A row for each run: the fields of its summary, its bounds checked."""
    found = spark.read.option("multiLine", True).option("pathGlobFilter", "summary_metrics.json").option("recursiveFileLookup", True).schema(schema).json(folder)
    for column, kind in found.dtypes:
        if kind == "double" and column.startswith("mean_"):
            found = require(found, F.col(column).isNull() | (F.col(column).between(0, 1) & ~F.isnan(column)), f"{column} isn't between 0 and 1")
    return found


def question_ids(rows: DataFrame) -> DataFrame:
    names = [c for c in ("question_id", "uid", "id") if c in rows.columns]
    return rows.select(first_truthy(*[F.trim(F.col(c).cast("string")) for c in names]).alias("question_id"))


def input_diagnostics(chunks: DataFrame, doc_id: str, chunk_id: str, text: str) -> DataFrame:
    size = F.length(text)
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct(doc_id).alias("n_docs"), F.min(size).cast("bigint").alias("min_chars"), F.max(size).cast("bigint").alias("max_chars"), F.round(F.avg(size), 6).alias("avg_chars"), (F.count(chunk_id) - F.count_distinct(chunk_id)).alias("duplicate_ids"))
