"""Eligibility, comparison groups, composite scores and competition ranks of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import reasons


def stretches(rows: DataFrame, by: str, n: int = 64) -> Column:
    """The number of each row's stretch of the rising order of a numeric column: at most ``n``, of about as many rows, nulls before all."""
    edges = sorted(set(rows.approxQuantile(by, [k / n for k in range(1, n)], 0.25 / n)))
    if not edges:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(by).cast("double"))), F.lit(0))


def places(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with their place 1, 2, 3, ... in the rising order of a numeric column, without gathering them in one task: the rows of the stretches before, and the place within the own one."""
    cut = rows.withColumn("_part", stretches(rows, by))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each stretch
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    numbered = cut.withColumn("_inside", inside).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_part", "_inside", "_before")


def competition_rank(rows: DataFrame, score: str, group: list[str] | None = None, eligible: Column | None = None) -> DataFrame:
    """Ranks 1, 2, 2, 4 by falling score within a group; rows that aren't eligible, and null scores, have rank null.

    Distinct scores are counted first, so many equal ones are one row; without a
    group, running sums are taken in ranges, so that no task sorts all scores.
    """
    ok = F.col(score).isNotNull() & F.coalesce(eligible if eligible is not None else F.lit(True), F.lit(False))
    keys = group or []
    marked = rows.withColumn("_ok", ok).withColumn("_score", F.when(F.col("_ok"), F.col(score)))
    counts = marked.where("_ok").groupBy(*keys, "_score").agg(F.count("*").alias("_n"))
    if keys:
        above = Window.partitionBy(*keys).orderBy(F.col("_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranks = counts.withColumn("_rank", F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1)
    else:
        ranged = counts.withColumn("_part", stretches(counts, "_score"))
        sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # a row for each stretch
        sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
        above = Window.partitionBy("_part").orderBy(F.col("_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranks = ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(above), F.lit(0))).join(F.broadcast(sums), "_part").withColumn("_rank", F.col("_before") + F.col("_inside") + 1)
    ranks = ranks.select(*[F.col(k).alias(f"_g{n}") for n, k in enumerate(keys)], F.col("_score").alias("_at"), "_rank")
    on = F.col("_score") == F.col("_at")
    for n, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_g{n}"))
    return marked.join(ranks, on, "left").select(*[c for c in rows.columns if c != "rank"], F.col("_rank").cast("bigint").alias("rank"))


def retrieval_eligibility(runs: DataFrame, most_failures: float) -> DataFrame:
    """Reasons against a run, and its status: an invalid run, too many failures, and the strict audit, in this order."""
    expected = F.coalesce(F.nullif("expected_questions", F.lit(0)), F.col("n_questions"))
    audit = reasons(
        (~F.col("manifest_present"), "manifest_missing"),
        (F.coalesce(F.col("final_verdict"), F.lit("")) != "valid", "final_verdict_invalid"),
        (~F.coalesce("strict_audit_pass", F.lit(False)), "strict_audit_failed"),
        (F.col("fake_run_suspicious"), "fake_run_detected"),
        (~F.col("outputs_present"), "required_output_missing"),
        ((expected <= 0) | (F.col("n_questions") != expected) | (F.coalesce("evaluated_rows", "n_questions") != expected) | (F.coalesce("source_rows", "evaluated_rows", "n_questions") != expected), "row_count_mismatch"),
        (F.col("duplicate_questions") > 0, "duplicate_question_ids"),
        ((F.col("distinct_questions") > 0) & (F.col("distinct_questions") != expected), "question_id_mismatch"),
    )
    status = F.when(~F.col("run_valid"), "excluded_run_invalid").when(F.col("failure_rate") > most_failures, "excluded_failure_rate").when(F.size("reasons") > 0, "excluded_strict_audit").otherwise("valid")
    made = runs.withColumn("reasons", audit).withColumn("status", status)
    last = F.when(F.col("status") == "excluded_run_invalid", F.array(F.lit("run_invalid"))).when(F.col("status") == "excluded_failure_rate", F.array(F.lit("failure_rate_exceeded"))).otherwise(F.array().cast("array<string>"))
    return made.withColumn("reasons", F.concat("reasons", last)).withColumn("eligible", F.col("status") == "valid")


def semantic_eligibility(runs: DataFrame, least_judged: float, most_nan: float) -> DataFrame:
    """NOT_AVAILABLE, INCOMPLETE, JUDGE_WARNING or VALID."""
    status = F.when(~F.coalesce("available", F.lit(False)), "NOT_AVAILABLE").when(F.col("missing_metrics") > 0, "INCOMPLETE").when(F.col("judge_success_rate") < least_judged, "JUDGE_WARNING").otherwise("VALID")
    return runs.withColumn("semantic_status", status).withColumn("nan_warning", F.coalesce(F.col("nan_rate") > most_nan, F.lit(False)))


def comparison_groups(runs: DataFrame, keys: list[str], eligible: Column) -> DataFrame:
    """Runs that may be compared: equal keys. ``incomparable`` says why a group ranks nothing."""
    groups = runs.groupBy(*keys).agg(F.array_sort(F.collect_list("experiment_id")).alias("members"), F.count("*").alias("n"), F.min(eligible).alias("complete"))
    unknown = None
    for k in keys:
        unknown = F.col(k).isNull() if unknown is None else unknown | F.col(k).isNull()
    return groups.withColumn("incomparable", F.when(unknown, "missing_key").when(F.col("n") < 2, "single_member"))


def formatted(value: Column) -> Column:
    """Six decimals, nothing for null, as leaderboard files write it."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.format_string("%.6f", value))
