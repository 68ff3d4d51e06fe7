"""Summaries, routing reports, audits and verdicts over evaluated rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.patterns import forbidden_terms

#: Metric columns that a summary averages, by how their names begin.
AT_K = (
    "hit_at_", "recall_at_", "mrr_at_", "ndcg_at_", "context_precision_at_", "duplicate_count_at_", "duplicate_rate_at_",
    "deduped_hit_at_", "deduped_recall_at_", "deduped_mrr_at_", "deduped_ndcg_at_",
    "chunk_hit_at_", "chunk_recall_at_", "chunk_mrr_at_", "chunk_ndcg_at_",
)


#: What run artifacts must not contain (fixed list).
LEAK_TERMS = (
    "answer-bearing question file", "legacy gold context file", "gold_answer", "ground_truth_answer", "expected_answer", "program_answer",
    "original_answer", "gold_context_id", "gold_context_ids", "context_id", "source_files",
)


def metric_columns(rows: DataFrame, prefixes: Iterable[str] = AT_K, extra: Iterable[str] = ()) -> list[str]:
    return [c for c in rows.columns if c.startswith(tuple(prefixes)) or c in tuple(extra)]


def summarize(rows: DataFrame, by: str, metrics: Iterable[str]) -> DataFrame:
    """Means by group, nulls left out; null where all are."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def summarize_with_all(rows: DataFrame, by: str, categories: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """Means for all rows, for every group, and for listed groups without rows (n = 0). One pass: each row counts for its group, the total is that of the groups."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *[x for m in metrics for x in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"))])
    whole = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[x for m in metrics for x in (F.sum(f"sum_{m}").alias(f"sum_{m}"), F.sum(f"n_{m}").alias(f"n_{m}"))]).withColumn("category", F.lit("all"))
    listed = categories.select(F.col(by).alias("category")).distinct()
    groups = sums.withColumnRenamed(by, "category").join(listed, "category", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    out = whole.unionByName(groups)
    return out.select("category", F.col("n").cast("bigint").alias("n"), *[(F.col(f"sum_{m}") / F.when(F.col(f"n_{m}") > 0, F.col(f"n_{m}"))).alias(f"mean_{m}") for m in metrics])


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return rows.groupBy(name(gold).alias("gold"), name(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """True and false positives and negatives, precision and recall (6 decimals) of each class of a confusion table."""
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    g = cells.groupBy(F.col("gold").alias("class")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    p = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("named"))
    both = g.join(p, "class", "full_outer").na.fill(0, ["tp", "support", "named"])
    ratio = lambda over: F.when(F.col(over) > 0, F.round(F.col("tp") / F.col(over), 6)).otherwise(0.0)
    return both.select("class", F.col("tp").cast("bigint").alias("tp"), (F.col("named") - F.col("tp")).cast("bigint").alias("fp"), (F.col("support") - F.col("tp")).cast("bigint").alias("fn"), ratio("named").alias("precision"), ratio("support").alias("recall"))


def macro_scores(classes: DataFrame) -> DataFrame:
    """Means of the rounded scores of the classes."""
    return classes.agg(F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"))


def rate(condition: Column) -> Column:
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 6)


def routing_report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Coverage and accuracy of predicted categories, and rates of fallbacks and index use.

    ``rows(predicted, gold, validated, fallback, index_used)``.
    """
    known = F.col("predicted").isNotNull()
    right = known & (F.lower("predicted") == F.lower("gold"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), rate(known).alias("coverage"), rate(F.col("validated")).alias("validated_coverage"),
        F.round(F.avg(F.when(known & F.col("gold").isNotNull(), right.cast("double"))), 6).alias("accuracy"), rate(right & F.col("validated")).alias("effective_accuracy"),
        rate(F.col("fallback")).alias("fallback_rate"), rate(~known).alias("unknown_rate"), rate(F.col("index_used")).alias("index_rate"),
    )


def run_validity(rows: DataFrame, by: str, failed: Column, most: float) -> DataFrame:
    made = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    return made.withColumn("failure_rate", F.col("failures") / F.col("n")).withColumn("run_valid", F.col("failure_rate") <= most)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def collisions(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """Keys with several distinct values."""
    return rows.select(key.alias("key"), value.alias("value")).distinct().groupBy("key").agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list("value")).alias("values")).where("n_values > 1")


def most_frequent(rows: DataFrame, value: Column) -> DataFrame:
    """The most frequent value, its share, and whether that is suspicious (5 rows or more, 80 % or more)."""
    counts = rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    best = counts.agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("top"))
    share = -F.col("top.n") / F.col("total")
    return best.select(F.col("top.value").alias("value"), (-F.col("top.n")).alias("n"), F.col("total"), F.round(share, 6).alias("share"), ((F.col("total") >= 5) & (share >= 0.8)).alias("suspicious"))


def alignment(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Full outer join of id sets: ``id`` and a flag for each table that has it."""
    out = None
    for name, t in tables:
        ids = t.toDF("id").distinct().withColumn(name, F.lit(True))
        out = ids if out is None else out.join(ids, "id", "full_outer")
    return out.select("id", *[F.coalesce(name, F.lit(False)).alias(name) for name, _ in tables])


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def reconcile(rows: DataFrame, key: str, sequence: str, valid: Column) -> DataFrame:
    """The last valid row of each key."""
    order = Window.partitionBy(key).orderBy(F.col(sequence).desc())
    return rows.where(F.coalesce(valid, F.lit(False))).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def question_order(key: Column) -> list[Column]:
    """Sort keys: Q and a number first, by the number, then anything else by its text."""
    number = F.regexp_extract(key, r"^Q(\d+)$", 1)
    return [number == "", F.when(number != "", number.cast("bigint")), key]


def reported_differences(reported: DataFrame, computed: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Long rows of metrics whose reported value isn't the computed one; a null against a value differs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"r.{m}").cast("double").alias("reported"), F.col(f"c.{m}").cast("double").alias("computed")) for m in metrics]))
    joined = reported.alias("r").join(computed.alias("c"), keys).select(*keys, pairs.alias("p")).select(*keys, "p.*")
    a, b = F.col("reported"), F.col("computed")
    return joined.where(~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))))


def semantic_summary(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means without null and NaN, with counts of valid and NaN values and their coverage."""
    out = [F.count("*").alias("n")]
    for m in metrics:
        ok = F.col(m).isNotNull() & ~F.isnan(m)
        out += [F.avg(F.when(ok, F.col(m))).alias(f"mean_{m}"), F.count_if(ok).alias(f"valid_{m}"), F.count_if(F.isnan(m)).alias(f"nan_{m}"), F.avg(ok.cast("double")).alias(f"coverage_{m}")]
    return rows.groupBy(by).agg(*out)


def reasons(*cases: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in cases]), lambda x: x.isNotNull())


def check_rows(one: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Turn one aggregated row into a row for each check: ``(check, passed)``."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])).alias("x")).select("x.*")


def leakage(texts: DataFrame, terms: Iterable[str] = LEAK_TERMS) -> DataFrame:
    """``(path, term)`` of forbidden terms, whatever their case, in ``texts(path, text)``; any number of terms costs one pass over the texts."""
    return forbidden_terms(texts.select(F.col("path").alias("text_id"), "text"), list(terms)).select(F.col("text_id").alias("path"), "term")


def verdict(serious: Column, minor: Column) -> Column:
    return F.when(serious, "invalid").when(minor, "partially_valid").otherwise("valid")
