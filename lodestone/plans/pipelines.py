"""Whole runs: answer all questions, evaluate the answers, rank the experiments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import RetrievalSettings
from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.functions.models import first_sentence, generate, hash_embedding
from lodestone.operators import evaluation as E
from lodestone.operators import leaderboard as L
from lodestone.operators import prompts as P
from lodestone.operators import retrieval as R
from lodestone.session import stored


def retrieve(questions: DataFrame, chunks: DataFrame, settings: RetrievalSettings, embed=None, *, boost: Callable[[DataFrame], Column] | None = None, keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Hits of all ``questions(query_id, question[, category])`` in ``chunks(item_id, text[, category])`` by the configured retriever.

    ``boost`` gives what is added to a dense hit's score, ``keep`` whether it
    passes the filter (all do, if none does); both see the hits with the columns
    of questions and chunks.
    """
    embed = embed or hash_embedding()
    s = settings
    tokens = T.german_tokens if s.analyzer == "german" else T.search_tokens
    more = [c for c in questions.columns if c not in ("query_id", *chunks.columns)]

    made: list[DataFrame] = []

    def vectors() -> list[DataFrame]:
        """Questions and chunks are embedded once, for all legs and all that reads them."""
        if not made:
            for rows, key, text, vector in ((questions, "query_id", "question", "query_vector"), (chunks, "item_id", "text", "vector")):
                made.append(stored(rows.select(key, *[c for c in ("category",) if c in rows.columns], embed(text).alias(vector)), "embedded"))
        return made

    def dense(k: int, within: str | None = None, exactly: bool = False) -> DataFrame:
        fetch = k if exactly else max(k, s.fetch_k)
        q, v = vectors()
        hits = R.dense_top_k(q, v.select("item_id", *([within] if within else []), "vector"), fetch if boost or keep else k, s.metric, within)
        if not (boost or keep):
            return hits
        seen = hits.select("query_id", "item_id", "score", "rank").join(chunks, "item_id").join(questions.select("query_id", *more), "query_id")
        seen = seen.withColumn("score", F.col("score") + boost(seen)) if boost else seen
        return R.top_k(R.filter_or_all(seen, keep(seen)) if keep else seen, k, "score", "query_id", "rank").select("query_id", "item_id", "score", "rank")

    def bm25(k: int, within: str | None = None) -> DataFrame:
        index = R.TextIndex.build(chunks, "item_id", "text", tokens, only=R.query_terms(questions, tokens))
        among = questions.select("query_id", within).join(chunks.select("item_id", within), within).select("query_id", "item_id") if within else None
        return R.bm25_top_k(questions, index, k, k1=s.k1, b=s.b, tokens=tokens, among=among)

    def hybrid(k: int, within: str | None = None) -> DataFrame:
        """Both legs are held to the category before they are cut and fused."""
        legs = dense(max(k, s.dense_fetch_k or s.fetch_k), within), bm25(max(k, s.bm25_fetch_k or s.fetch_k), within)
        return R.rrf_fuse(*legs, k, s.rrf_k, (s.dense_weight, s.bm25_weight))

    if s.retriever in ("bm25", "dense", "hybrid"):
        return {"bm25": bm25, "dense": dense, "hybrid": hybrid}[s.retriever](s.top_k)
    search = hybrid if s.retriever == "adaptive_hybrid" else dense
    routes = questions.select("query_id", F.col("category").isNotNull().alias("routed"))
    if s.retriever != "category" and s.validate_routing:
        probe = (hybrid(s.probe_k) if s.retriever == "adaptive_hybrid" else dense(s.probe_k, exactly=True)).select("query_id", "item_id", "score").join(chunks.select("item_id", "category"), "item_id")
        support = R.probe_support(probe, questions.select("query_id", F.col("category").alias("predicted")))
        decided = R.routing_decision(support, s.minimum_category_share, s.minimum_category_count, s.minimum_margin)
        routes = decided.select("query_id", (F.col("accepted") & F.col("predicted").isNotNull()).alias("routed"))
    return R.category_or_global(search(s.top_k, "category"), search(s.top_k), routes)


def answer(questions: DataFrame, chunks: DataFrame, settings: RetrievalSettings, call: Callable[[str], str] = first_sentence, *, max_chars: int = 6000, max_words: int = 1500, embed=None, boost=None, keep=None, reranker: Callable[[Column, Column], Column] | None = None, parents: DataFrame | None = None, parent_words: int = 800) -> DataFrame:
    """A result row for each question: what was retrieved, the answer, or the error of that question alone.

    With a ``reranker`` of (question, text), ``fetch_k`` hits are scored anew and
    ``rerank_top_k`` of them chosen from; ``dedupe_by`` names a column of the
    chunks of which each value is used once; ``parents(item_id, parents)`` gives
    the sections that are shown in the place of chunks, as ``expand_parents``.
    """
    wide = replace(settings, top_k=max(settings.top_k, settings.fetch_k)) if reranker or settings.dedupe_by or parents is not None else settings
    more = [settings.dedupe_by] if settings.dedupe_by and settings.dedupe_by != "item_id" else []
    hits = retrieve(questions, chunks, wide, embed, boost=boost, keep=keep).select("query_id", "item_id", "score", "rank").join(chunks.select("item_id", "text", *more), "item_id")
    if reranker:
        asked = hits.join(questions.select("query_id", "question"), "query_id")
        hits = R.select_unique(R.rerank(asked, reranker(F.col("question"), F.col("text"))), wide.top_k, settings.rerank_top_k or settings.top_k).drop("question")
    if settings.dedupe_by:
        hits = R.dedupe_hits(hits, wide.top_k, settings.dedupe_by)
    shown = hits.where(F.col("rank") <= settings.top_k)
    contexts = shown
    if parents is not None:
        contexts = R.expand_parents(hits.join(parents.select("item_id", "parents"), "item_id", "left").withColumn("parents", F.coalesce("parents", F.array().cast(parents.schema["parents"].dataType))), parent_words, settings.top_k)
        contexts = contexts.withColumn("score", F.lit(None).cast("double"))
    fit = R.within_budget(R.first_by_text(contexts), max_chars, max_words)
    answers = generate(P.build_prompts(questions.select("query_id", "question"), fit), call)
    return P.export_rows(questions.select("query_id", "question").join(answers, "query_id", "left"), shown)


def evaluate(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Metrics of each result row; ``gold(query_id, gold_ids, gold_answer)``. Failed generations score 0 in quality."""
    rows = results.join(gold, "query_id", "left")
    failed = M.generation_failed(F.col("error"), F.lit(None).cast("boolean"), F.col("answer"))
    columns = [F.col("query_id"), failed.alias("failed"), M.is_unknown(F.col("answer")).cast("double").alias("unknown"), T.is_abstention(F.col("answer")).alias("abstained")]
    columns.append(F.when(failed, 0.0).otherwise(T.lexical_f1(F.col("question"), F.col("answer"))).alias("lexical_f1"))
    match = F.when(F.coalesce(F.trim("gold_answer"), F.lit("")) == "", "no_gold").when(T.normalize_text(F.col("answer")) == T.normalize_text(F.col("gold_answer")), "match").otherwise("mismatch")
    columns.append(F.when(failed, "failed").otherwise(match).alias("match_status"))
    for k in ks:
        raw = M.rank_metrics(F.col("retrieved_chunk_ids"), F.col("gold_ids"), k)
        names = {"hit": "hit", "recall": "recall", "mrr": "mrr", "ndcg": "ndcg", "precision": "context_precision", "duplicates": "duplicate_count", "duplicate_rate": "duplicate_rate"}
        columns += [raw[m].alias(f"{n}_at_{k}") for m, n in names.items()]
        columns += [c.alias(f"deduped_{m}_at_{k}") for m, c in M.distinct_rank_metrics(F.col("retrieved_chunk_ids"), F.col("gold_ids"), k).items()]
    return rows.select(*columns)


def summarize_run(evaluated: DataFrame, experiment: str, most_failures: float = 0.05) -> DataFrame:
    rows = evaluated.withColumn("experiment_id", F.lit(experiment))
    means = E.summarize(rows, "experiment_id", E.metric_columns(rows, extra=("unknown", "lexical_f1")))
    return means.join(E.run_validity(rows, "experiment_id", F.col("failed"), most_failures).drop("n"), "experiment_id")


def rank_experiments(retrieval: DataFrame, semantic: DataFrame, keys: list[str], most_failures: float = 0.05) -> DataFrame:
    """Leaderboard rows: eligibility, retrieval score and rank, quality index and rank within comparison groups."""
    runs = L.retrieval_eligibility(retrieval, most_failures).join(semantic, "experiment_id", "left")
    score = M.retrieval_score(F.col("mean_ndcg_at_5"), F.col("mean_recall_at_5"), F.col("mean_mrr_at_5"))
    index = M.quality_index(
        score, M.answer_quality(F.col("mean_bertscore"), F.col("mean_similarity")), M.faithfulness(F.col("mean_ragas_faithfulness"), F.col("mean_judge_faithfulness")),
        M.generation_quality(F.col("mean_judge_correctness"), F.col("mean_judge_context"), F.col("mean_judge_completeness")),
    )
    made = runs.withColumns({"retrieval_score": score, "quality_index": F.when(F.col("eligible"), index)})
    ranked = L.competition_rank(made, "retrieval_score", keys, F.col("eligible")).withColumnRenamed("rank", "retrieval_rank")
    return L.competition_rank(ranked, "quality_index", keys, F.col("eligible")).withColumnRenamed("rank", "quality_rank")
