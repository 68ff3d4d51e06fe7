"""Files that tell how runs did: summaries, leaderboards, comparisons; and what reads them side by side."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.leaderboard import formatted

#: Metrics of a summary that are told at cuts (fixed names): ``mean_hit_at_5`` becomes ``hit@5``.
CUT_METRICS = ("hit", "recall", "mrr", "ndcg", "chunk_hit", "chunk_recall", "chunk_mrr", "chunk_ndcg")


def compact_summary(summary: DataFrame, ks: list[int], first: tuple[str, ...] = ("experiment_id", "n")) -> DataFrame:
    """A summary under the short names of its file: identifiers, then each cut's metrics, then whatever else; metrics it lacks are null."""
    cuts = [(f"mean_{m}_at_{k}", f"{m}@{k}") for k in sorted({1, 3, 5, *ks}) for m in CUT_METRICS]
    known = {long for long, _ in cuts}
    rest = [c for c in summary.columns if c not in known and c not in first]
    return summary.select(
        *[F.col(c) for c in first if c in summary.columns],
        *[(F.col(long) if long in summary.columns else F.lit(None).cast("double")).alias(short) for long, short in cuts],
        *[F.col(c).alias(c.removeprefix("mean_")) for c in rest],
    )


def leaderboard(records: DataFrame, rank: str, fields: list[str]) -> DataFrame:
    """The fields of ranked records as a file tells them: six decimals, nothing for null; those without a rank come last."""
    kinds = dict(records.dtypes)

    def told(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return formatted(F.col(c))
        return F.coalesce(F.array_join(F.col(c).cast("array<string>"), ";") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit(""))

    return records.orderBy(F.col(rank).asc_nulls_last(), "experiment_id").select(*[told(c).alias(c) for c in fields])


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A table of at most ``most`` rows, which a reader can still take in; that there are more is said below it."""
    listed = rows.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in listed[:most]]
    if len(listed) > most:
        lines.append(f"\nThe first {most:,} rows; the files hold them all.")
    return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(records: DataFrame, folder: str, boards: dict[str, tuple[str, list[str]]], title: str) -> None:
    """Each board ``name: (rank, fields)`` as CSV and JSON lines, and all of them in one Markdown comparison."""
    spark, parts = records.sparkSession, [f"# {title}\n"]
    for name, (rank, fields) in boards.items():
        board = leaderboard(records, rank, fields)
        board.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{name}.csv")
        records.orderBy(F.col(rank).asc_nulls_last(), "experiment_id").select(*fields).write.mode("overwrite").json(f"{folder}/{name}.json")
        parts += [f"## {name}\n", markdown_table(board)]
    write_text(spark, f"{folder}/comparison.md", "\n".join(parts))


def read_summaries(spark: SparkSession, paths: list[str], bounded: tuple[str, ...] = ()) -> DataFrame:
    """Summary files, a JSON document each, that hold exactly one experiment: its fields, and the file. ``bounded`` ones must be finite and between 0 and 1."""
    docs = spark.read.option("multiLine", True).json(paths).withColumn("file", F.input_file_name())
    one = F.when(F.size("summary_by_experiment") == 1, F.col("summary_by_experiment")[0]).otherwise(F.raise_error(F.concat(F.lit("not exactly one experiment in "), "file")))
    rows = docs.select("file", one.alias("s")).select("file", "s.*")

    def held(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(v.isNull() | v.between(0, 1), v).otherwise(F.raise_error(F.concat(F.lit(f"{c} is out of bounds in "), "file")))

    return rows.withColumns({c: held(c) for c in bounded if c in rows.columns})


def semantic_summaries(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Summaries of semantic runs: the experiment is the run without ``p3_``; shares of NaN follow from their counts; ``missing_metrics`` counts what a run lacks."""
    made = rows.withColumn("experiment_id", F.regexp_replace("run_id", "^p3_", ""))
    rates = {f"nan_rate_{m}": F.when(F.col("n") > 0, F.coalesce(F.col(f"nan_{m}"), F.lit(0)) / F.col("n")) for m in metrics if f"nan_{m}" in rows.columns}
    missing = F.lit(0)
    for m in metrics:
        missing = missing + (F.col(f"mean_{m}").isNull().cast("int") if f"mean_{m}" in rows.columns else F.lit(1))
    return made.withColumns(rates).withColumn("missing_metrics", missing)


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """``run_manifest.json`` of a run, else ``manifest.json``, through Spark's file systems."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in ("run_manifest.json", "manifest.json"):
        at = files(f"{folder.rstrip('/')}/{name}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return json.loads("".join(r[0] for r in spark.read.text(str(at.toString()), wholetext=True).collect()))  # one file
    raise FileNotFoundError(f"no manifest in {folder}")


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, sha256, size)`` of whole files, read where the tasks run."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def canonical_hash(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def linked_runs(evaluations: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Each evaluated run with the hash it was evaluated at and the one it has now; ``skipped`` where the run is gone."""
    now = runs.select(key, F.col("sha256").alias("sha256_now"))
    joined = evaluations.join(now, key, "left")
    state = F.when(F.col("sha256_now").isNull(), "skipped").when(F.col("sha256") == F.col("sha256_now"), "unchanged").otherwise("changed")
    return joined.withColumn("state", state)


def semantic_inputs(results: DataFrame, questions: DataFrame, contexts: DataFrame, gold: DataFrame | None, key: str = "question_id") -> DataFrame:
    """One row for each result with its question, contexts and gold; without gold its columns are null, and ``gold_available`` says so."""
    out = results.join(questions.select(key, *[c for c in questions.columns if c not in results.columns]), key, "left")
    out = out.join(contexts.select(key, *[c for c in contexts.columns if c not in out.columns]), key, "left")
    if gold is None:
        return out.withColumns({"gold_answer": F.lit(None).cast("string"), "gold_available": F.lit(False)})
    mine = [c for c in gold.columns if c not in out.columns]
    return out.join(gold.select(key, *mine, F.lit(True).alias("gold_available")), key, "left").withColumn("gold_available", F.coalesce("gold_available", F.lit(False)))


def parent_store_violations(mapping: DataFrame, sections: DataFrame) -> DataFrame:
    """Mapped chunks whose section the store lacks, and sections that are named twice."""
    lost = mapping.where("parent_id is not null").join(sections.select("parent_id").distinct(), "parent_id", "left_anti").select(F.col("item_id").cast("string").alias("id"), F.lit("missing_section").alias("rule"))
    twice = sections.groupBy("parent_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("parent_id").cast("string").alias("id"), F.lit("repeated_section").alias("rule"))
    return lost.unionByName(twice)


def preflight(settings: dict, rows: dict[str, DataFrame], needed: dict[str, tuple[str, ...]]) -> list[str]:
    """What keeps a run from starting: absent or empty inputs, absent fields, cuts that don't fit each other."""
    out = []
    for name, fields in needed.items():
        table = rows.get(name)
        if table is None:
            out.append(f"{name} is missing")
            continue
        out += [f"{name} lacks the field {f}" for f in fields if f not in table.columns]
        if table.isEmpty():
            out.append(f"{name} has no rows")
    top_k, fetch_k = settings.get("top_k"), settings.get("fetch_k")
    if not isinstance(top_k, int) or top_k < 1:
        out.append("top_k must be a positive integer")
    elif isinstance(fetch_k, int) and fetch_k < top_k:
        out.append("fetch_k must not be less than top_k")
    return out


def granularity(settings: dict, has_documents: bool, has_chunks: bool) -> dict[str, object]:
    """At which level retrieval is judged, what counts as relevant there, and which metrics lead."""
    wanted = settings.get("granularity", "auto")
    if wanted not in ("auto", "document", "chunk", "both"):
        raise ValueError(f"unknown granularity {wanted!r}")
    if wanted in ("chunk", "both") and not has_chunks:
        raise ValueError("chunk-level evaluation needs annotated chunks")
    if wanted in ("document", "both") and not has_documents:
        raise ValueError("document-level evaluation needs gold documents")
    document = has_documents if wanted == "auto" else wanted != "chunk"
    chunk = has_chunks if wanted == "auto" else wanted != "document"
    lead = "chunk" if chunk else "document" if document else None
    return {
        "document": document, "chunk": chunk, "primary": lead,
        "relevant": {"chunk": "the chunk holds an evidence span", "document": "the document is a gold document", None: None}[lead],
        "leading_metrics": [f"{'chunk_' if lead == 'chunk' else ''}{m}" for m in ("ndcg", "recall", "mrr", "hit")] if lead else [],
    }


def show_runs(spark: SparkSession, pattern: str, fields: list[str]) -> DataFrame:
    """The summary rows of all runs side by side, with the folder each came from."""
    rows = spark.read.option("header", True).csv(pattern).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return rows.select("run", *[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields]).orderBy("run")


def main(argv: list[str] | None = None) -> None:
    """``python -m lodestone.sources.reports SUMMARY_GLOB FIELD...`` prints summary rows across runs."""
    import sys

    from lodestone.session import local_session

    pattern, *fields = argv if argv is not None else sys.argv[1:]
    show_runs(local_session(), pattern, fields).show(1000, truncate=False)


if __name__ == "__main__":
    main()
