"""Finished runs as tables: projections of result rows, roll-ups, and the checks that a run must pass.

Result rows are read with whatever fields they have; a field that the schema
lacks is null here. Roll-ups are one conditional aggregate over the rows, and
checks are rows ``(check, passed[, found])`` made from it, so that a run of any
size is judged in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .evaluation import check_rows, reasons

#: Names under which result files carry a field, the first found counts (fixed names).
ALIASES = {
    "dense_candidates": ("dense_candidate_count", "es_hybrid_dense_candidates"),
    "bm25_candidates": ("bm25_candidate_count", "es_hybrid_bm25_candidates"),
    "fused_candidates": ("fused_candidate_count", "es_hybrid_fused_candidates"),
    "reranked_candidates": ("reranked_candidate_count", "reranker_output_count"),
    "final_contexts": ("final_context_count", "final_result_count"),
}
#: Retrievers that decide between category and global search.
ADAPTIVE = ("adaptive_category_aware_dense", "adaptive_category_aware_hybrid_rrf")


def field(rows: DataFrame, path: str, kind: str | None = None) -> Column:
    """A field of the rows by its dotted path, null where the schema has none."""
    at, schema = None, rows.schema
    for name in path.split("."):
        if not isinstance(schema, StructType) or name not in schema.names:
            return F.lit(None).cast(kind or "string")
        at = F.col(f"`{name}`") if at is None else at[name]
        schema = schema[name].dataType
    return at.cast(kind) if kind else at


def _first(rows: DataFrame, paths: Iterable[str], kind: str) -> Column:
    return F.coalesce(*(field(rows, p, kind) for p in paths))


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


# ---- projections ----


def context_texts(rows: DataFrame) -> Column:
    """The contexts of a row: those given to the generator, else those retrieved, else the texts of the retrieved chunks; blank ones left out."""

    def texts(path: str) -> Column:
        return F.nullif(F.filter(field(rows, path, "array<string>"), lambda t: F.trim(t) != ""), F.array().cast("array<string>"))

    lists = [texts(p) for p in ("generation_context_texts", "retrieved_context_texts", "retrieved_chunk_texts")]
    kind = rows.schema["retrieved_chunks"].dataType if "retrieved_chunks" in rows.schema.names else None
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        named = [n for n in ("chunk_text", "text") if n in kind.elementType.names]
        if named:
            chunk_texts = F.transform("retrieved_chunks", lambda c: F.coalesce(*(F.nullif(c[n], F.lit("")) for n in named)))
            lists.append(F.filter(chunk_texts, lambda t: F.trim(t) != ""))
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        lists.append(texts("retrieved_chunks"))
    return F.coalesce(*lists, F.array().cast("array<string>"))


def routing_executed(rows: DataFrame) -> Column:
    """Whether categories steered the search: by the retriever's type, or by a recorded decision on a predicted category."""
    kind = F.coalesce(field(rows, "retriever_type"), field(rows, "diagnostics.retriever_type"), F.lit(""))
    predicted = F.coalesce(_given(field(rows, "detected_category")), _given(field(rows, "diagnostics.predicted_category")))
    return kind.contains("category") | (field(rows, "diagnostics.routing_decision").isin("accepted", "rejected") & predicted.isNotNull())


def retrieved_chunk_ids(rows: DataFrame, question: str = "question_id") -> Column:
    """The identifiers a chunk-level evaluation judges: the row's own list, else those of its chunks. Blank ones, and rows without any, are errors."""

    def stop(why: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{why} for question "), F.col(question).cast("string")))

    own = F.transform(field(rows, "retrieved_chunk_ids", "array<string>"), lambda i: F.trim(i))
    kind = rows.schema["retrieved_chunks"].dataType if "retrieved_chunks" in rows.schema.names else None
    nested = F.lit(None).cast("array<string>")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "chunk_id" in kind.elementType.names:
        if not isinstance(kind.elementType["chunk_id"].dataType, StringType):
            raise TypeError("chunk_id of retrieved_chunks must be a string")
        nested = F.filter(F.transform("retrieved_chunks", lambda c: F.trim(c["chunk_id"])), lambda i: i != "")
    if "retrieved_chunk_ids" in rows.schema.names and rows.schema["retrieved_chunk_ids"].dataType != ArrayType(StringType(), rows.schema["retrieved_chunk_ids"].dataType.containsNull if isinstance(rows.schema["retrieved_chunk_ids"].dataType, ArrayType) else True):
        raise TypeError("retrieved_chunk_ids must be a list of strings")
    return (
        F.when(own.isNotNull() & F.exists(own, lambda i: F.coalesce(i, F.lit("")) == ""), stop("blank chunk identifiers"))
        .when(own.isNotNull(), own)
        .when(F.size(nested) > 0, nested)
        .otherwise(stop("no stable chunk identifiers"))
    )


def retrieval_only(rows: DataFrame, answer_metrics: Iterable[str]) -> DataFrame:
    """Rows of a run that only retrieves: its answer metrics are null, and it says so."""
    return rows.withColumns({m: F.lit(None).cast("double") for m in answer_metrics} | {"answer_status": F.lit("skipped_retrieval_only")})


def without_orchestration(questions: DataFrame) -> DataFrame:
    """Questions as they are, without a category."""
    return questions.withColumns({"cleaned_question": F.col("question"), "category": F.lit(None).cast("string"), "category_reason": F.lit("orchestration_disabled"), "orchestration_latency_ms": F.lit(0.0)})


# ---- roll-ups ----


def flat(rows: DataFrame) -> DataFrame:
    """What the roll-ups read of result rows, under one name each."""
    d = "diagnostics."
    columns = {name: F.coalesce(_first(rows, [d + n for n in names], "bigint"), F.lit(0)) for name, names in ALIASES.items()}
    fallback = F.coalesce(field(rows, d + "fallback_used", "boolean"), F.lit(False)) | F.coalesce(field(rows, d + "category_fallback_used", "boolean"), F.lit(False))
    return rows.select(
        field(rows, "experiment_id", "string").alias("experiment_id"),
        field(rows, "question_id", "string").alias("question_id"),
        _given(field(rows, "error", "string")).isNotNull().alias("failed"),
        (field(rows, "diagnostics").isNotNull() if "diagnostics" in rows.columns else F.lit(False)).alias("diagnosed"),
        (F.coalesce(field(rows, d + "orchestration_status"), F.lit("")) == "enabled").alias("attempted"),
        _given(field(rows, "orchestration_error")).isNull().alias("orchestrated"),
        (F.coalesce(field(rows, "category_validated", "boolean"), F.lit(False)) | F.coalesce(field(rows, d + "category_validated", "boolean"), F.lit(False))).alias("validated"),
        F.coalesce(field(rows, d + "category_validated", "boolean"), F.lit(False)).alias("validated_in_search"),
        F.coalesce(_given(field(rows, "detected_category")), _given(field(rows, d + "predicted_category"))).isNull().alias("unknown"),
        field(rows, d + "routing_decision").alias("decision"),
        F.coalesce(_given(field(rows, d + "final_retrieval_mode")), _given(field(rows, d + "retrieval_scope")), F.lit("")).alias("mode"),
        field(rows, d + "retrieval_scope").alias("scope"),
        fallback.alias("fallback"),
        F.coalesce(field(rows, d + "reranker_applied", "boolean"), F.lit(False)).alias("reranked"),
        F.coalesce(field(rows, d + "category_filter_applied", "boolean"), F.lit(False)).alias("filtered"),
        F.coalesce(field(rows, d + "category_filter_applied_dense", "boolean"), F.lit(False)).alias("filtered_dense"),
        F.coalesce(field(rows, d + "category_filter_applied_bm25", "boolean"), F.lit(False)).alias("filtered_bm25"),
        field(rows, d + "top_k", "int").alias("top_k"),
        *[c.alias(name) for name, c in columns.items()],
    )


def routing_rollup(rows: DataFrame, by: str = "experiment_id") -> DataFrame:
    """Accepted, rejected, invalid and fallback routes of each run, their rates, and whether the counts agree with each other."""
    routed = F.col("diagnosed") & F.col("decision").isin("accepted", "rejected")
    undecided = F.col("diagnosed") & ~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False))
    category = routed & (F.col("mode") == "category") & ~F.col("fallback")
    to_global = routed & ~category & ((F.col("mode") == "global") | F.col("fallback"))
    counts = {
        "total_questions": F.lit(True),
        "orchestration_attempted": F.col("diagnosed") & F.col("attempted"),
        "orchestration_succeeded": F.col("diagnosed") & F.col("attempted") & F.col("orchestrated"),
        "valid_categories": F.col("diagnosed") & F.col("validated"),
        "invalid_categories": F.col("diagnosed") & ~F.col("validated"),
        "unknown_categories": F.col("diagnosed") & F.col("unknown"),
        "accepted": routed & (F.col("decision") == "accepted"),
        "rejected": routed & (F.col("decision") == "rejected"),
        "failed_before_routing": undecided & F.col("failed"),
        "missing_diagnostics": ~F.col("diagnosed") | (undecided & ~F.col("failed")),
        "routed_questions": routed,
        "routed_unvalidated": routed & ~F.col("validated_in_search"),
        "category_routes": category,
        "global_routes": to_global,
        "fallbacks": routed & F.col("fallback"),
        "global_fallbacks": routed & (F.col("fallback") | (F.col("mode") == "global")),
    }
    made = flat(rows).groupBy(by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
    rates = {"acceptance_rate": "accepted", "category_route_rate": "category_routes", "global_route_rate": "global_routes", "fallback_rate": "fallbacks"}
    made = made.withColumns({r: F.when(F.col("routed_questions") > 0, F.col(n) / F.col("routed_questions")).otherwise(0.0) for r, n in rates.items()})
    agree = (
        (F.col("category_routes") + F.col("global_routes") == F.col("routed_questions"))
        & (F.col("orchestration_attempted") <= F.col("total_questions"))
        & (F.col("routed_questions") + F.col("failed_before_routing") + F.col("missing_diagnostics") <= F.col("total_questions"))
    )
    return made.withColumn("consistent", agree)


def evidence_rollup(rows: DataFrame, retriever: str, by: str = "experiment_id") -> DataFrame:
    """Candidates of each leg over the rows that succeeded, what evidence they leave, and whether routes reconcile with rows."""
    ok = ~F.col("failed")
    adaptive = retriever in ADAPTIVE
    routed = ok & F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False)) & F.lit(adaptive)
    category = routed & (F.col("mode") == "category") & ~F.col("fallback")
    to_global = routed & ~category & ((F.col("mode") == "global") | F.col("fallback"))
    proven = (F.col("filtered_dense") & F.col("filtered_bm25")) if retriever.endswith("hybrid_rrf") else F.col("filtered")
    legs = ("dense", "bm25", "fused", "reranked")
    all_legs = (F.col("dense_candidates") > 0) & (F.col("bm25_candidates") > 0) & (F.col("fused_candidates") > 0)
    global_only = ~((F.col("scope").isNotNull() & (F.col("scope") != "global")) | F.col("filtered"))
    made = flat(rows).groupBy(by).agg(
        F.count("*").alias("total_questions"),
        F.count_if(ok).alias("successful_questions"),
        F.count_if(~ok).alias("failed_questions"),
        *[F.sum(F.when(ok, F.col(f"{leg}_candidates")).otherwise(0)).alias(f"{leg}_total") for leg in legs],
        F.coalesce(F.bool_or(ok & all_legs), F.lit(False)).alias("hybrid_evidence"),
        F.coalesce(F.bool_or(ok & F.col("reranked") & (F.col("reranked_candidates") > 0)), F.lit(False)).alias("reranking_evidence"),
        F.count_if(routed).alias("rows_with_routing"),
        (F.count_if(ok & ~routed) if adaptive else F.lit(0).cast("bigint")).alias("rows_missing_routing"),
        F.count_if(category).alias("category_routes"),
        F.count_if(to_global).alias("global_routes"),
        F.count_if(routed & F.col("fallback") & ~category).alias("fallback_routes"),
        F.count_if(category & ~proven).alias("unproven_categories"),
        (F.bool_and(~ok | global_only) if retriever == "elasticsearch_hybrid_rrf" else F.lit(False)).alias("global_only"),
    )
    status = F.lit("not_applicable")
    if adaptive:
        fits = (F.col("rows_with_routing") == F.col("successful_questions")) & (F.col("category_routes") + F.col("global_routes") == F.col("rows_with_routing")) & (F.col("unproven_categories") == 0)
        status = F.when(fits, "PASS").otherwise("FAIL")
    return made.withColumn("reconciliation", status)


def reconciled_stats(expected: DataFrame, rows: DataFrame, key: str = "question_id", position: str = "position") -> DataFrame:
    """One row: expected, successful, missing and repeated questions, and PASS if the rows are the questions in their order.

    ``expected(key, position)`` and ``rows(key, position)`` have their places in
    their files; orders agree if the ranks of equal places do.
    """
    wanted = expected.select(F.col(key).alias("id"), F.col(position).alias("wanted_at"))
    given = rows.select(F.col(key).alias("id"), F.col(position).alias("given_at"))
    per = given.groupBy("id").agg(F.count("*").alias("n"), F.min("given_at").alias("given_at"))
    both = wanted.join(per, "id", "full_outer")
    one = both.agg(
        F.count("wanted_at").alias("expected_questions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("successful_questions"),
        F.count_if(F.col("wanted_at").isNotNull() & F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("wanted_at").isNull()).alias("unexpected"),
        F.count_if(~F.col("wanted_at").eqNullSafe(F.col("given_at"))).alias("misplaced"),
    )
    good = (F.col("successful_questions") == F.col("expected_questions")) & (F.col("missing") + F.col("repeated") + F.col("unexpected") + F.col("misplaced") == 0)
    return one.withColumn("failed_questions", F.col("missing") + F.col("repeated")).withColumn("run_status", F.when(good, "PASS").otherwise("FAIL"))


def performance(rows: DataFrame, retrieval_ms: str, generation_ms: str, elapsed_s: Column, by: str | None = None) -> DataFrame:
    """Questions a second, and mean milliseconds of retrieval and generation, to three decimals; null without rows."""
    grouped = rows.groupBy(by) if by else rows.groupBy()
    n = F.count("*")
    return grouped.agg(
        n.alias("attempted"),
        F.when(n > 0, F.round(n / F.greatest(elapsed_s, F.lit(1e-9)), 3)).otherwise(0.0).alias("questions_per_sec"),
        F.round(F.sum(retrieval_ms) / F.nullif(n, F.lit(0)), 3).alias("avg_retrieval_ms"),
        F.round(F.sum(generation_ms) / F.nullif(n, F.lit(0)), 3).alias("avg_generation_ms"),
    )


def fallback_summary(rows: DataFrame, fallback: Column) -> DataFrame:
    return rows.agg(F.count_if(fallback).alias("fallbacks"), F.coalesce(F.avg(F.coalesce(fallback, F.lit(False)).cast("double")), F.lit(0.0)).alias("fallback_rate"))


def status_counts(rows: DataFrame, status: Column, *by: str) -> DataFrame:
    """How many rows have each status, ``missing`` for none."""
    return rows.groupBy(*by, F.coalesce(_given(status), F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def input_coverage(results: DataFrame, questions: DataFrame, gold: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """One row: sizes, intersections and coverage of the three inputs, and examples of questions that lack a result or gold."""
    sides = {"results": results, "questions": questions, "gold": gold}
    out = None
    for name, t in sides.items():
        ids = t.select(F.col(key).alias("id")).distinct().withColumn(name, F.lit(True))
        out = ids if out is None else out.join(ids, "id", "full_outer")
    has = {n: F.coalesce(F.col(n), F.lit(False)) for n in sides}

    def first(c: Column) -> Column:
        return F.slice(F.array_sort(F.collect_set(F.when(c, F.col("id")))), 1, examples)

    # examples come from a bounded list: the smallest identifiers of each kind, found before they are gathered
    lacks = {"without_result": has["questions"] & ~has["results"], "without_gold": has["questions"] & ~has["gold"]}
    one = out.agg(
        *[F.count_if(c).alias(f"n_{n}") for n, c in has.items()],
        F.count_if(has["results"] & has["questions"]).alias("results_in_questions"),
        F.count_if(has["results"] & has["gold"]).alias("results_in_gold"),
        F.count_if(has["results"] & has["questions"] & has["gold"]).alias("in_all"),
    )
    for name, c in lacks.items():
        some = out.where(c).orderBy("id").limit(examples)
        one = one.crossJoin(F.broadcast(some.agg(first(F.lit(True)).alias(name))))  # one row on either side
    rate = lambda n: F.when(F.col("n_questions") > 0, F.col(n) / F.col("n_questions"))
    return one.withColumn("question_coverage", rate("results_in_questions")).withColumn("aligned", (F.col("in_all") == F.col("n_results")) & (F.col("in_all") == F.col("n_questions")) & (F.col("in_all") == F.col("n_gold")))


def rows_per_experiment(results: DataFrame, expected: Column, by: str = "experiment_id") -> DataFrame:
    """Rows of each experiment against the number of questions; a difference is suspicious."""
    return results.groupBy(F.coalesce(F.col(by), F.lit("")).alias(by)).agg(F.count("*").alias("n")).withColumn("suspicious", (expected > 0) & (F.col("n") != expected))


def annotation_summary(gold: DataFrame, question: str, chunk: str, span: str) -> DataFrame:
    return gold.agg(F.count_distinct(question).alias("questions"), F.count_distinct(chunk).alias("gold_chunks"), F.count(chunk).alias("references"), F.count_distinct(span).alias("mapped_spans"))


# ---- checks ----


#: What in the name of a chunk configuration tells its strategy.
STRATEGIES = {"character": "character", "sentence": "sentence", "fixed": "fixed_token"}


def chunk_config(name: Column, strategies: dict[str, str] = STRATEGIES) -> Column:
    """Strategy, size and overlap that a chunk configuration's name tells: the first of ``strategies`` that it contains, and the numbers after ``sentence`` or ``fixed`` and ``overlap``."""
    low = F.lower(name)
    number = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).cast("int")
    strategy = F.coalesce(*[F.when(low.contains(part), told) for part, told in strategies.items()])
    return F.struct(strategy.alias("strategy"), F.coalesce(number(r"sentence(\d+)"), number(r"fixed(\d+)")).alias("chunk_size"), number(r"overlap_?(\d+)").alias("chunk_overlap"))


def chunk_compatibility(rows: DataFrame, package: DataFrame) -> DataFrame:
    """Checks of result rows against a one-row annotation ``package(chunk_config_id, questions, loaded_questions, dataset_status, unmapped_records[, strategy, chunk_size, chunk_overlap])``.

    What a summary states counts before what the configuration's name tells.
    Rows that state nothing pass.
    """
    config = field(rows, "chunk_config_id", "string")
    seen = rows.agg(
        F.collect_set(_given(config)).alias("configs"),  # bounded: the configurations of one run
        F.collect_set(F.lower(_given(field(rows, "chunking_strategy", "string")))).alias("strategies"),
        F.collect_set(F.expr("try_cast(chunk_size AS INT)") if "chunk_size" in rows.columns else F.lit(None).cast("int")).alias("sizes"),
        F.collect_set(F.expr("try_cast(chunk_overlap AS INT)") if "chunk_overlap" in rows.columns else F.lit(None).cast("int")).alias("overlaps"),
    )
    told = chunk_config(F.col("chunk_config_id"))
    expected = package.select(
        "chunk_config_id", "questions", "loaded_questions", "dataset_status", "unmapped_records",
        F.lower(F.coalesce(field(package, "strategy", "string"), told["strategy"])).alias("strategy"),
        F.coalesce(field(package, "chunk_size", "int"), told["chunk_size"]).alias("chunk_size"),
        F.coalesce(field(package, "chunk_overlap", "int"), told["chunk_overlap"]).alias("chunk_overlap"),
    )
    one = expected.crossJoin(F.broadcast(seen))  # one row on either side

    def same(found: str, wanted: str) -> Column:
        return (F.size(found) == 0) | F.col(wanted).isNull() | (F.col(found) == F.array(wanted))

    return check_rows(one, {
        "question_count": F.col("questions").isNull() | (F.col("questions") == F.col("loaded_questions")),
        "dataset_status": F.coalesce(F.col("dataset_status"), F.lit("")).isin("", "PASS"),
        "unmapped_records": F.coalesce(F.col("unmapped_records"), F.lit(0)) == 0,
        "chunk_config": (F.size("configs") == 0) | F.col("chunk_config_id").isNull() | F.array_contains("configs", F.col("chunk_config_id")),
        "strategy": same("strategies", "strategy"),
        "chunk_size": same("sizes", "chunk_size"),
        "chunk_overlap": same("overlaps", "chunk_overlap"),
    })


def fake_run_checks(rows: DataFrame, questions: int, *, missing_files: int = 0, evaluated: int = 0, reported_failures: int = 0, leaks: int = 0, latency: str = "latency_ms", retrieved: str = "retrieved_chunk_ids", least: int = 5, share: float = 0.8) -> DataFrame:
    """``(check, suspicious)``: the eleven signs of a run that was made up.

    Row counts, repeated questions and repeated answers come from one pass each
    with map-side aggregation; models and retrievers from the sets of a run.
    """
    answer = _given(field(rows, "generated_answer", "string"))
    per = rows.groupBy("experiment_id", "question_id").agg(F.count("*").alias("n"))
    per_run = per.groupBy("experiment_id").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    shape = per_run.agg(F.coalesce(F.bool_or(F.col("rows") != questions), F.lit(False)).alias("miscounted"), F.coalesce(F.max("most"), F.lit(0)).alias("most"))
    answers = rows.select(answer.alias("answer")).where("answer is not null").groupBy("answer").agg(F.count("*").alias("n"))
    answers = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("answers"), F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    kinds = ("llm_model", "embedding_model", "retriever_type")
    lists = F.coalesce(F.size(F.col(retrieved)), F.lit(0)) if retrieved in rows.columns else F.lit(0)
    facts = rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.bool_and(lists <= 0), F.lit(False)).alias("nothing_retrieved"),
        F.coalesce(F.bool_and(F.coalesce(field(rows, latency, "double"), F.lit(0.0)) == 0), F.lit(False)).alias("no_time"),
        *[F.approx_count_distinct(_given(field(rows, k, "string"))).alias(k) for k in kinds],
        *[F.min(_given(field(rows, k, "string"))).alias(f"{k}_low") for k in kinds],
        *[F.max(_given(field(rows, k, "string"))).alias(f"{k}_high") for k in kinds],
    )
    one = facts.crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(answers))  # one row each
    mixed = None
    for k in kinds:  # several values have a least and a greatest that differ
        differ = F.coalesce(F.col(f"{k}_low") != F.col(f"{k}_high"), F.lit(False))
        mixed = differ if mixed is None else mixed | differ
    return check_rows(one, {
        "result_file_missing": F.lit(missing_files > 0),
        "zero_rows": F.col("rows") == 0,
        "rows_do_not_match_questions": F.lit(questions > 0) & F.col("miscounted"),
        "repeated_questions": F.col("most") > 1,
        "metrics_without_rows": F.lit(evaluated > 0) & (F.col("rows") == 0),
        "reported_metrics_differ": F.lit(reported_failures > 0),
        "leakage": F.lit(leaks > 0),
        "many_answers_identical": (F.col("answers") >= least) & (F.col("top") >= share * F.col("answers")),
        "nothing_retrieved": F.col("nothing_retrieved"),
        "no_latencies": F.col("no_time"),
        "several_models": mixed,
    }).withColumnRenamed("passed", "suspicious")


def manifest_checks(manifests: DataFrame) -> DataFrame:
    """``(run_id, check, suspicious)`` for ``manifests(run_id, present, readable, expected_sha256, actual_sha256, n_queries, result_rows, started, ended)``: a missing or unreadable one is its only check."""
    started, ended = F.try_to_timestamp("started"), F.try_to_timestamp("ended")
    checks = {
        "hash_mismatch": F.coalesce(F.col("expected_sha256") != F.col("actual_sha256"), F.lit(False)),
        "question_count_mismatch": F.coalesce(F.col("n_queries") != F.col("result_rows"), F.lit(False)),
        "impossible_times": F.coalesce(ended < started, F.lit(True)),
    }
    pair = lambda n, c: F.struct(F.lit(n).alias("check"), c.alias("suspicious"))
    made = F.when(~F.coalesce("present", F.lit(False)), F.array(pair("manifest_missing", F.lit(True))))
    made = made.when(~F.coalesce("readable", F.lit(False)), F.array(pair("manifest_unreadable", F.lit(True)))).otherwise(F.array(*[pair(n, c) for n, c in checks.items()]))
    return manifests.select("run_id", F.explode(made).alias("x")).select("run_id", "x.*")


def source_violations(rows: DataFrame, *, experiment: str | None = None, retriever: str | None = None, top_k: int | None = None, hybrid: bool = False, reranker: bool = False, routing: bool = False) -> DataFrame:
    """``(question_id, violations)``: what each result row breaks of its run's contract; rows that break nothing are left out."""
    d = "diagnostics."
    diagnosed = field(rows, "diagnostics").isNotNull() if "diagnostics" in rows.columns else F.lit(False)
    number = {n: _first(rows, [d + x for x in names], "bigint") for n, names in ALIASES.items()}

    def bad(c: Column) -> Column:
        return diagnosed & F.coalesce(c < 0, F.lit(True))

    kind = F.coalesce(field(rows, "retriever_type", "string"), field(rows, d + "retriever_type", "string"))
    mode = F.coalesce(field(rows, "retrieval_mode", "string"), field(rows, d + "retrieval_mode", "string"), F.lit(""))
    scope = F.coalesce(_given(field(rows, d + "retrieval_scope")), _given(field(rows, "retrieval_scope")), F.lit(""))
    decision = F.coalesce(field(rows, d + "routing_decision"), F.lit(""))
    final = F.coalesce(_given(field(rows, d + "final_retrieval_mode")), _given(field(rows, d + "retrieval_scope")), F.lit(""))
    fallback = F.coalesce(field(rows, d + "fallback_used", "boolean"), F.lit(False)) | F.coalesce(field(rows, d + "category_fallback_used", "boolean"), F.lit(False))
    filtered = F.coalesce(field(rows, d + "category_filter_applied_dense", "boolean"), F.lit(False)) & F.coalesce(field(rows, d + "category_filter_applied_bm25", "boolean"), F.lit(False))
    limit = F.coalesce(F.nullif(field(rows, d + "top_k", "int"), F.lit(0)), F.lit(top_k).cast("int"), F.nullif(field(rows, "retrieval_k", "int"), F.lit(0)))
    decided = decision.isin("accepted", "rejected") & final.isin("category", "global")
    cases = [(~diagnosed, "missing_diagnostics"), (bad(number["final_contexts"]), "bad_final_count"), (diagnosed & (number["final_contexts"] > limit), "more_contexts_than_top_k")]
    if experiment is not None:
        cases.append((~field(rows, "experiment_id", "string").eqNullSafe(F.lit(experiment)), "experiment_id"))
    if retriever is not None:
        cases.append((~kind.eqNullSafe(F.lit(retriever)), "retriever_type"))
        if retriever == "adaptive_category_aware_hybrid_rrf":
            cases.append((mode == "adaptive_category_aware_dense", "mislabelled_mode"))
        if retriever == "elasticsearch_hybrid_rrf":
            cases += [(diagnosed & ~scope.isin("", "global"), "scope"), (diagnosed & decision.isin("accepted", "rejected"), "unexpected_routing")]
    if hybrid:
        cases += [(bad(number[f"{leg}_candidates"]), f"bad_{leg}_count") for leg in ("dense", "bm25", "fused")]
    if reranker:
        applied = F.coalesce(field(rows, "reranker_applied", "boolean"), F.lit(False)) | F.coalesce(field(rows, d + "reranker_applied", "boolean"), F.lit(False))
        cases += [(diagnosed & ~applied, "no_reranking"), (bad(number["reranked_candidates"]), "bad_reranked_count")]
    if routing:
        cases += [(diagnosed & ~decided, "no_routing_outcome"), (diagnosed & decided & (final == "category") & ~fallback & ~filtered, "no_filter_evidence")]
    return rows.select(field(rows, "question_id", "string").alias("question_id"), reasons(*cases).alias("violations")).where(F.size("violations") > 0)


def source_contract(rows: DataFrame, manifest: DataFrame, expected: dict[str, str | int | bool], **row_rules) -> DataFrame:
    """``(check, passed)`` of a finished run against its one-row ``manifest`` and what is ``expected`` of its columns.

    The manifest must have status PASS and no failed question; rows must be as
    many as it expects, break no rule of ``source_violations``, leave evidence
    of the legs that are required, and agree with its counts of routes.
    """
    routing, hybrid, reranker = (bool(row_rules.get(k)) for k in ("routing", "hybrid", "reranker"))
    broken = source_violations(rows, **row_rules).agg(F.count("*").alias("broken"))
    f = flat(rows)
    routed = F.coalesce(F.col("decision").isin("accepted", "rejected") & F.col("mode").isin("category", "global"), F.lit(False))
    category = routed & (F.col("mode") == "category") & ~F.col("fallback")
    totals = f.agg(
        F.count("*").alias("rows"), *[F.coalesce(F.sum(f"{leg}_candidates"), F.lit(0)).alias(leg) for leg in ("dense", "bm25", "fused", "reranked")],
        F.count_if(routed).alias("routed"), F.count_if(category).alias("in_category"), F.count_if(routed & F.col("fallback")).alias("fell_back"),
    )
    one = manifest.select(*[field(manifest, n).alias(f"m_{n}") for n in dict.fromkeys([*expected, "run_status", "failed_questions", "expected_questions", "successful_questions", "category_route_count", "global_route_count", "fallback_count"])])
    one = one.crossJoin(F.broadcast(broken)).crossJoin(F.broadcast(totals))  # one row each
    checks = {"run_status": F.col("m_run_status") == "PASS", "no_failed_questions": F.col("m_failed_questions").cast("int") == 0, "rows_present": F.col("rows") > 0}
    checks |= {f"manifest_{n}": F.col(f"m_{n}") == F.lit(v) for n, v in expected.items()}
    checks |= {"row_count": F.col("m_expected_questions").isNull() | (F.col("m_expected_questions").cast("bigint") == F.col("rows")), "rows_keep_contract": F.col("broken") == 0}
    if hybrid:
        checks["hybrid_evidence"] = (F.col("dense") > 0) & (F.col("bm25") > 0) & (F.col("fused") > 0)
    if reranker:
        checks["reranking_evidence"] = F.col("reranked") > 0
    if routing:
        checks["all_rows_routed"] = F.col("routed") == F.coalesce(F.col("m_successful_questions").cast("bigint"), F.col("rows"))
        checks["routes_reconcile"] = (F.col("m_category_route_count").cast("bigint") == F.col("in_category")) & (F.col("m_global_route_count").cast("bigint") == F.col("routed") - F.col("in_category")) & (F.col("m_fallback_count").cast("bigint") == F.col("fell_back"))
    return check_rows(one, checks)


def input_violations(results: DataFrame, gold: DataFrame, questions: DataFrame, official: bool = False) -> DataFrame:
    """``(rule, n, severity)`` of what is wrong with the inputs of a semantic evaluation; rules without a case are left out.

    Missing tables, identifiers, repeated questions, missing gold and failed
    manifests are errors; missing answers, contexts and question texts are
    errors only in ``official`` mode; empty gold answers are warnings.
    """
    key = lambda t: F.coalesce(*(_given(field(t, n, "string")) for n in ("question_id", "uid", "id")))
    listed = lambda t, *names: F.coalesce(*(field(t, n).isNotNull() if n in t.columns else F.lit(None).cast("boolean") for n in names), F.lit(False)) if len(names) == 1 else None
    has = {n: listed(results, n) for n in ("generation_context_texts", "retrieved_context_texts", "retrieved_chunk_texts", "retrieved_chunks")}
    retrieved = has["retrieved_context_texts"] | has["retrieved_chunk_texts"] | has["retrieved_chunks"]
    asked = F.coalesce(_given(field(results, "question", "string")), _given(field(results, "question_text", "string")))
    r = results.select(
        key(results).alias("id"), _given(field(results, "generated_answer", "string")).isNull().alias("no_answer"), (~(has["generation_context_texts"] | retrieved)).alias("no_context"),
        (~retrieved).alias("no_retrieved"), (~has["generation_context_texts"]).alias("no_generation"), asked.isNull().alias("no_question"),
    )
    g = gold.select(key(gold).alias("id"), F.coalesce(*(_given(field(gold, n, "string")) for n in ("answer", "reference_answer", "gold_answer"))).isNull().alias("empty")).where("id is not null").groupBy("id").agg(F.bool_and("empty").alias("empty"))
    counts = r.agg(F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("missing_id"), *[F.count_if(c).alias(c) for c in ("no_answer", "no_context", "no_retrieved", "no_generation", "no_question")])
    repeated = r.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    without = r.where("id is not null").join(g, "id", "left_anti").agg(F.count("*").alias("without_gold"))
    answers = g.agg(F.count("*").alias("gold"), F.count_if("empty").alias("empty_answers"))
    asked_rows = questions.agg(F.count("*").alias("questions"))
    one = counts
    for other in (repeated, without, answers, asked_rows):
        one = one.crossJoin(F.broadcast(other))  # one row each
    soft = "error" if official else "warning"
    rules = [
        ("zero_results", (F.col("rows") == 0).cast("bigint"), "error"), ("zero_gold", (F.col("gold") == 0).cast("bigint"), "error"), ("zero_questions", (F.col("questions") == 0).cast("bigint"), "error"),
        ("missing_question_id", F.col("missing_id"), "error"), ("repeated_question_id", F.col("repeated"), "error"), ("missing_gold", F.col("without_gold"), "error"),
        ("missing_answer", F.col("no_answer"), soft), ("missing_contexts", F.col("no_context"), soft), ("missing_retrieved_contexts", F.col("no_retrieved"), soft),
        ("missing_generation_contexts", F.col("no_generation"), soft), ("missing_question_text", F.col("no_question"), soft), ("empty_gold_answers", F.col("empty_answers"), "warning"),
    ]
    listed_rules = F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("bigint").alias("n"), F.lit(s).alias("severity")) for n, c, s in rules])
    return one.select(F.explode(listed_rules).alias("x")).select("x.*").where("n > 0")


def experiment_records(summary: DataFrame, validation: DataFrame, scores: DataFrame, groups: DataFrame, key: str = "experiment_id") -> DataFrame:
    """One wide record for each experiment of ``summary``: its means, validity, scores and comparison group; what is missing is null, and ``complete`` says whether anything is."""
    out = summary
    for name, t in (("validation", validation), ("scores", scores), ("groups", groups)):
        mine = [c for c in t.columns if c not in out.columns]
        out = out.join(t.select(key, *mine, F.lit(True).alias(f"has_{name}")), key, "left")
    flags = [F.coalesce(F.col(f"has_{n}"), F.lit(False)) for n in ("validation", "scores", "groups")]
    return out.withColumn("complete", flags[0] & flags[1] & flags[2]).drop("has_validation", "has_scores", "has_groups")


def repaired(rows: DataFrame, fixed: DataFrame, key: str = "question_id") -> DataFrame:
    """A finished run with the rows of ``fixed`` in the place of those with their keys; a key the run lacks, or two fixed rows of one key, are errors."""
    new = fixed.select(*rows.columns)
    n = F.count("*")
    per = new.groupBy(key).agg(F.when(n > 1, F.raise_error(F.lit("several repaired rows of one key"))).otherwise(n).alias("n"))
    known = per.join(rows.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    checked = known.select(key, F.when(F.col("known").isNull(), F.raise_error(F.lit("a repaired row belongs to no row of the run"))).otherwise(F.col("n")).alias("n"))
    return rows.join(fixed.select(key), key, "left_anti").unionByName(new.join(checked.where("n = 1").select(key), key, "left_semi"))
