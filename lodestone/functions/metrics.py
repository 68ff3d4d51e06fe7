"""Ranking, answer, efficiency and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = F.lit


def _some(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def rank_metrics(retrieved: Column, gold: Column, k: int) -> dict[str, Column]:
    """Metrics of the first ``k`` slots of a ranked list, repeated items keep their slots.

    Recall is null without gold, the others 0 then.
    """
    top, wanted = F.slice(_some(retrieved), 1, k), F.array_distinct(_some(gold))
    shared = F.size(F.array_intersect(F.array_distinct(top), wanted))
    n_gold, n_top = F.size(wanted), F.size(top)
    gains = F.transform(top, lambda x, i: F.when(F.array_contains(wanted, x) & (F.array_position(top, x) == i + 1), 1.0 / F.log2((i + 2).cast("double"))).otherwise(D(0.0)))
    dcg = F.aggregate(gains, D(0.0), lambda s, g: s + g)
    ideal = F.aggregate(F.when(n_gold > 0, F.sequence(D(1), F.least(n_gold, D(k)))).otherwise(F.array().cast("array<int>")), D(0.0), lambda s, i: s + 1.0 / F.log2((i + 1).cast("double")))
    first = F.array_min(F.filter(F.transform(wanted, lambda g: F.array_position(top, g)), lambda p: p > 0))
    repeats = n_top - F.size(F.array_distinct(top))
    return {
        "hit": F.when(shared > 0, 1.0).otherwise(0.0),
        "recall": F.when(n_gold > 0, shared / n_gold),
        "mrr": F.coalesce(1.0 / first, D(0.0)),
        "precision": F.when(n_top > 0, shared / n_top).otherwise(0.0),
        "ndcg": F.when(n_gold > 0, dcg / ideal).otherwise(0.0),
        "duplicates": repeats.cast("bigint"),
        "duplicate_rate": F.when(n_top > 0, repeats / n_top).otherwise(0.0),
    }


def distinct_rank_metrics(retrieved: Column, gold: Column, k: int) -> dict[str, Column]:
    """The same after blank and repeated items are dropped."""
    kept = F.array_distinct(F.filter(_some(retrieved), lambda x: x.isNotNull() & (F.trim(x) != "")))
    made = rank_metrics(kept, gold, k)
    return {m: made[m] for m in ("hit", "recall", "mrr", "ndcg")}


def chunk_metrics(retrieved: Column, gold: Column, k: int) -> dict[str, Column]:
    """Chunk level: blanks are dropped before ranking, and recall is 0 without gold."""
    kept = F.filter(_some(retrieved), lambda x: x.isNotNull() & (F.trim(x) != ""))
    made = rank_metrics(kept, gold, k)
    return {"hit": made["hit"], "recall": F.coalesce(made["recall"], D(0.0)), "mrr": made["mrr"], "ndcg": made["ndcg"]}


def duplicate_rate(items: Column) -> Column:
    n = F.size(_some(items))
    return F.when(n > 0, (n - F.size(F.array_distinct(_some(items)))) / n).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), D(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, unequal or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.coalesce(F.when(fit, dot(a, b) / norms), D(0.0))


def retrieval_score(ndcg: Column, recall: Column, mrr: Column, weights=(0.60, 0.25, 0.15)) -> Column:
    return weights[0] * ndcg + weights[1] * recall + weights[2] * mrr


def answer_quality(bert: Column, similarity: Column) -> Column:
    return 0.5 * bert + 0.5 * similarity


def faithfulness(ragas: Column, judge: Column) -> Column:
    return 0.5 * ragas + 0.5 * (judge / 5.0)


def generation_quality(correctness: Column, context: Column, completeness: Column) -> Column:
    return 0.4 * (correctness / 5.0) + 0.3 * (context / 5.0) + 0.3 * (completeness / 5.0)


def quality_index(retrieval: Column, answer: Column, faithful: Column, generation: Column, weights=(0.30, 0.20, 0.25, 0.25)) -> Column:
    return weights[0] * retrieval + weights[1] * answer + weights[2] * faithful + weights[3] * generation


def judge_overall(correctness: Column, faithful: Column, completeness: Column, hallucination: Column, context: Column, weights=(0.30, 0.25, 0.20, 0.15, 0.10)) -> Column:
    """Weighted mean of scores of 0 to 5, hallucination inverted, with 4 decimals."""
    parts = (correctness, faithful, completeness, 5.0 - hallucination, context)
    total = D(0.0)
    for w, p in zip(weights, parts, strict=True):
        total = total + w * (p / 5.0)
    return F.round(total * 5.0, 4)


def fallback_reason(used: Column, error: Column, validated: Column, reason: Column, n_results: Column, top_k: Column) -> Column:
    said = F.lower(F.coalesce(reason, D("")))
    unclear = (F.when(said.contains("empty") | said.contains("missing"), "no_category_detected").when(said.contains("not found"), "invalid_category").when(said.contains("failed"), "no_category_detected").otherwise("other"))
    few = F.coalesce(n_results, D(0)) < F.coalesce(top_k, D(1))
    return F.when(F.coalesce(used, D(False)), F.when(F.coalesce(error, D("")) != "", "no_category_detected").when(~F.coalesce(validated, D(False)), unclear).when(few, "insufficient_category_results").otherwise("other"))


def retrieval_generation_latency(pipeline: Column, retriever: Column, retrieval: Column, rerank: Column, generation: Column, legacy: Column) -> Column:
    """The parts that are known, null only if none is and the legacy field is null too."""
    def total(*parts: Column) -> Column:
        known = F.coalesce(*parts).isNotNull()
        out = D(0.0)
        for p in parts:
            out = out + F.coalesce(p, D(0.0))
        return F.when(known, out)

    parts = F.when(pipeline.isNotNull(), total(pipeline, generation)).when(retriever.isNotNull(), total(retriever, rerank, generation)).otherwise(total(retrieval, rerank, generation))
    return F.coalesce(parts, legacy)


def category_accuracy(predicted: Column, gold: Column) -> Column:
    p, g = (F.nullif(F.lower(F.trim(c)), D("")) for c in (predicted, gold))
    return F.when(p.isNotNull() & g.isNotNull(), (p == g).cast("double"))


def is_unknown(answer: Column) -> Column:
    return F.lower(F.trim(F.coalesce(answer, D("")))).isin("unknown", "unbekannt")


def generation_failed(error: Column, success: Column, answer: Column) -> Column:
    return (F.coalesce(F.trim(error), D("")) != "") | ~F.coalesce(success, D(True)) | (F.coalesce(F.trim(answer), D("")) == "")
