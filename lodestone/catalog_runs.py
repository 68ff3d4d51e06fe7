"""Registered queries of the run checks and roll-ups, each with the SQL that states the same.

The result rows of finished runs are made from ``documents``: a run for each
source and a question for each document, with fields that follow from its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import LONG, query, six, table
from lodestone.operators import runs as U

_RESULTS = """
    SELECT doc_id, source AS experiment_id, 'Q' || doc_id AS question_id, doc_id % 13 = 0 AS failed, CASE WHEN doc_id % 11 > 0 THEN 'answer ' || (doc_id % 4) END AS answer,
        doc_id % 17 <> 0 AS diagnosed, doc_id % 2 = 0 AS attempted, doc_id % 9 <> 0 AS orchestrated, doc_id % 5 <> 0 AS validated, doc_id % 17 <> 0 AND doc_id % 15 <> 0 AS validated_in_search,
        doc_id % 10 = 0 OR lang IS NULL AS unknown, CASE WHEN doc_id % 17 = 0 OR doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 1 THEN 'rejected' ELSE 'accepted' END AS decision,
        CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 4 = 0 THEN 'category' ELSE 'global' END AS mode, doc_id % 17 <> 0 AND doc_id % 6 = 0 AS fallback,
        CASE WHEN doc_id % 17 <> 0 THEN doc_id % 7 ELSE 0 END AS dense, CASE WHEN doc_id % 17 <> 0 THEN doc_id % 5 ELSE 0 END AS bm25, CASE WHEN doc_id % 17 <> 0 THEN doc_id % 4 ELSE 0 END AS fused,
        CASE WHEN doc_id % 17 <> 0 THEN doc_id % 3 ELSE 0 END AS reranked, doc_id % 17 <> 0 AND doc_id % 3 <> 0 AS applied, doc_id % 8 AS final, doc_id % 12 <> 0 AS filtered_dense FROM documents"""


def _results(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    diagnostics = F.struct(
        F.when(i % 2 == 0, "enabled").otherwise("disabled").alias("orchestration_status"), F.when(i % 10 != 0, F.col("lang")).alias("predicted_category"), (i % 15 != 0).alias("category_validated"),
        F.when(i % 4 == 3, None).when(i % 4 == 1, "rejected").otherwise("accepted").alias("routing_decision"), F.when(i % 4 == 0, "category").otherwise("global").alias("final_retrieval_mode"),
        (i % 6 == 0).alias("fallback_used"), (i % 7).alias("dense_candidate_count"), (i % 5).alias("es_hybrid_bm25_candidates"), (i % 4).alias("fused_candidate_count"),
        (i % 3).alias("reranked_candidate_count"), (i % 3 != 0).alias("reranker_applied"), (i % 8).alias("final_context_count"), F.lit(5).alias("top_k"),
        (i % 12 != 0).alias("category_filter_applied_dense"), F.lit(True).alias("category_filter_applied_bm25"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("experiment_id"), F.concat(F.lit("Q"), i).alias("question_id"), F.when(i % 13 == 0, "timeout").alias("error"),
        F.when(i % 11 > 0, F.concat(F.lit("answer "), i % 4)).otherwise("").alias("generated_answer"), F.when(i % 9 == 0, "bad reply").alias("orchestration_error"),
        F.when(i % 10 != 0, F.col("lang")).alias("detected_category"), ((i % 17 != 0) & (i % 5 != 0)).alias("category_validated"), F.lit("adaptive_category_aware_hybrid_rrf").alias("retriever_type"),
        F.concat(F.lit("model "), i % 2).alias("llm_model"), (i % 3).alias("latency_ms"), F.when(i % 17 != 0, diagnostics).alias("diagnostics"),
        F.when(i % 14 != 0, F.array(F.concat(F.lit("d"), i), F.lit(" "))).alias("generation_context_texts"), F.when(i % 14 != 0, F.array(F.concat(F.lit("r"), i))).alias("retrieved_context_texts"),
        F.array(F.struct(F.concat(F.lit(" c"), i).alias("chunk_id"), F.concat(F.lit("t"), i).alias("chunk_text"))).alias("retrieved_chunks"),
    )


@query(f"""
WITH r AS ({_RESULTS}), x AS (SELECT *, diagnosed AND decision IS NOT NULL AS routed FROM r), y AS (SELECT *, routed AND mode = 'category' AND NOT fallback AS category FROM x)
SELECT experiment_id, count(*) AS total_questions, count(*) FILTER (diagnosed AND attempted) AS orchestration_attempted, count(*) FILTER (diagnosed AND attempted AND orchestrated) AS orchestration_succeeded,
    count(*) FILTER (diagnosed AND (validated OR validated_in_search)) AS valid_categories, count(*) FILTER (diagnosed AND NOT (validated OR validated_in_search)) AS invalid_categories, count(*) FILTER (diagnosed AND unknown) AS unknown_categories,
    count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (diagnosed AND decision IS NULL AND failed) AS failed_before_routing,
    count(*) FILTER (NOT diagnosed OR (decision IS NULL AND NOT failed)) AS missing_diagnostics, count(*) FILTER (routed) AS routed_questions, count(*) FILTER (routed AND NOT validated_in_search) AS routed_unvalidated,
    count(*) FILTER (category) AS category_routes, count(*) FILTER (routed AND NOT category AND (mode = 'global' OR fallback)) AS global_routes, count(*) FILTER (routed AND fallback) AS fallbacks,
    count(*) FILTER (routed AND (fallback OR mode = 'global')) AS global_fallbacks, round(coalesce(count(*) FILTER (decision = 'accepted') / nullif(count(*) FILTER (routed), 0), 0), 6) AS acceptance_rate,
    round(coalesce(count(*) FILTER (category) / nullif(count(*) FILTER (routed), 0), 0), 6) AS category_route_rate, round(coalesce(count(*) FILTER (routed AND NOT category) / nullif(count(*) FILTER (routed), 0), 0), 6) AS global_route_rate,
    round(coalesce(count(*) FILTER (routed AND fallback) / nullif(count(*) FILTER (routed), 0), 0), 6) AS fallback_rate, TRUE AS consistent FROM y GROUP BY experiment_id""")
def ag10_routing_rollup(spark, sf_dir):
    made = U.routing_rollup(_results(spark, sf_dir))
    return made.withColumns({c: six(c) for c in made.columns if c.endswith("_rate")})


@query(f"""
WITH r AS (SELECT *, decision IS NOT NULL AND NOT failed AS routed FROM ({_RESULTS})), y AS (SELECT *, routed AND mode = 'category' AND NOT fallback AS category FROM r)
SELECT experiment_id, count(*) AS total_questions, count(*) FILTER (NOT failed) AS successful_questions, count(*) FILTER (failed) AS failed_questions,
    sum(CASE WHEN failed THEN 0 ELSE dense END)::BIGINT AS dense_total, sum(CASE WHEN failed THEN 0 ELSE bm25 END)::BIGINT AS bm25_total, sum(CASE WHEN failed THEN 0 ELSE fused END)::BIGINT AS fused_total, sum(CASE WHEN failed THEN 0 ELSE reranked END)::BIGINT AS reranked_total,
    coalesce(bool_or(NOT failed AND dense > 0 AND bm25 > 0 AND fused > 0), FALSE) AS hybrid_evidence, coalesce(bool_or(NOT failed AND applied AND reranked > 0), FALSE) AS reranking_evidence,
    count(*) FILTER (routed) AS rows_with_routing, count(*) FILTER (NOT failed AND NOT routed) AS rows_missing_routing, count(*) FILTER (category) AS category_routes, count(*) FILTER (routed AND NOT category) AS global_routes,
    count(*) FILTER (routed AND fallback AND NOT category) AS fallback_routes, count(*) FILTER (category AND NOT filtered_dense) AS unproven_categories, FALSE AS global_only,
    CASE WHEN count(*) FILTER (routed) = count(*) FILTER (NOT failed) AND count(*) FILTER (category AND NOT filtered_dense) = 0 THEN 'PASS' ELSE 'FAIL' END AS reconciliation FROM y GROUP BY experiment_id""")
def ag11_evidence_rollup(spark, sf_dir):
    return U.evidence_rollup(_results(spark, sf_dir), "adaptive_category_aware_hybrid_rrf")


@query("""
WITH e AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS a FROM documents), r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS b FROM labels), p AS (SELECT id, count(*) AS n, min(b) AS b FROM r GROUP BY id), j AS (SELECT a, b, n FROM e FULL JOIN p USING (id))
SELECT count(a) AS expected_questions, coalesce(sum(n), 0)::BIGINT AS successful_questions, count(*) FILTER (a IS NOT NULL AND n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (a IS NULL) AS unexpected,
    count(*) FILTER (a IS DISTINCT FROM b) AS misplaced, count(*) FILTER (a IS NOT NULL AND n IS NULL) + count(*) FILTER (n > 1) AS failed_questions, CASE WHEN count(*) FILTER (a IS DISTINCT FROM b OR n > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS run_status FROM j""")
def ag12_reconciled_stats(spark, sf_dir):
    return U.reconciled_stats(_placed(spark, sf_dir, "documents"), _placed(spark, sf_dir, "labels"))


def _placed(spark, sf_dir, name: str) -> DataFrame:
    """Identifiers with their places in the order of identifiers, by range partitions and their sizes."""
    from lodestone.operators.leaderboard import places

    return places(table(spark, sf_dir, name).select(F.col("doc_id").alias("question_id")), "question_id", "position")


@query("SELECT event_type, count(*) AS attempted, round(count(*) / 60e0, 3) AS questions_per_sec, round(sum(value) / count(*), 3) AS avg_retrieval_ms, round(sum(value * 2) / count(*), 3) AS avg_generation_ms FROM events GROUP BY event_type")
def ag13_performance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("twice", F.col("value") * 2)
    return U.performance(rows, "value", "twice", F.lit(60.0), "event_type")


@query("SELECT count(*) FILTER (doc_id % 6 = 0) AS fallbacks, round(avg((doc_id % 6 = 0)::INT), 6) AS fallback_rate FROM documents")
def ag06_fallback_summary(spark, sf_dir):
    return U.fallback_summary(table(spark, sf_dir, "documents"), F.col("doc_id") % 6 == 0).withColumn("fallback_rate", six("fallback_rate"))


@query("SELECT source, coalesce(nullif(trim(lang), ''), 'missing') AS status, count(*) AS n FROM documents GROUP BY ALL")
def ag08_status_counts(spark, sf_dir):
    return U.status_counts(table(spark, sf_dir, "documents"), F.col("lang"), "source")


@query("""
WITH j AS (SELECT coalesce(r.id, q.id, g.id) AS id, r.id IS NOT NULL AS r, q.id IS NOT NULL AS q, g.id IS NOT NULL AS g FROM (SELECT DISTINCT doc_id AS id FROM labels) r FULL JOIN (SELECT doc_id AS id FROM documents) q ON r.id = q.id FULL JOIN (SELECT vec_id AS id FROM embeddings) g ON g.id = coalesce(r.id, q.id))
SELECT count(*) FILTER (r) AS n_results, count(*) FILTER (q) AS n_questions, count(*) FILTER (g) AS n_gold, count(*) FILTER (r AND q) AS results_in_questions, count(*) FILTER (r AND g) AS results_in_gold, count(*) FILTER (r AND q AND g) AS in_all,
    coalesce((SELECT array_to_string(list(id ORDER BY id), ',') FROM (SELECT id FROM j WHERE q AND NOT r ORDER BY id LIMIT 5)), '') AS without_result, coalesce((SELECT array_to_string(list(id ORDER BY id), ',') FROM (SELECT id FROM j WHERE q AND NOT g ORDER BY id LIMIT 5)), '') AS without_gold,
    round(count(*) FILTER (r AND q) / count(*) FILTER (q), 6) AS question_coverage, count(*) FILTER (r AND q AND g) = count(*) FILTER (r) AND count(*) FILTER (r) = count(*) FILTER (q) AND count(*) FILTER (q) = count(*) FILTER (g) AS aligned FROM j""")
def ag16_input_coverage(spark, sf_dir):
    key = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("id_"))
    made = U.input_coverage(key("labels", "doc_id"), key("documents", "doc_id"), key("embeddings", "vec_id"), "id_")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return made.withColumns({"without_result": text("without_result"), "without_gold": text("without_gold"), "question_coverage": six("question_coverage")})


@query("SELECT source AS experiment_id, count(*) AS n, count(*) <> 50 AS suspicious FROM documents GROUP BY source")
def ag18_rows_per_experiment(spark, sf_dir):
    return U.rows_per_experiment(_results(spark, sf_dir), F.lit(50))


@query("SELECT count(DISTINCT source) AS questions, count(DISTINCT doc_id) AS gold_chunks, count(doc_id) AS \"references\", count(DISTINCT lang) AS mapped_spans FROM documents")
def ag20_annotation_summary(spark, sf_dir):
    return U.annotation_summary(table(spark, sf_dir, "documents"), "source", "doc_id", "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 14 <> 0 THEN 'd' || doc_id ELSE 't' || doc_id END AS contexts FROM documents")
def pr11_context_texts(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return rows.select("doc_id", F.array_join(U.context_texts(rows), "|").alias("contexts"))


@query("SELECT doc_id, kind <> 'dense' OR (doc_id % 17 <> 0 AND doc_id % 4 <> 3 AND doc_id % 10 <> 0 AND lang IS NOT NULL) AS executed FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'category_aware' ELSE 'dense' END AS kind FROM documents)")
def pr12_routing_executed(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("retriever_type", F.when(F.col("doc_id") % 3 == 0, "category_aware").otherwise("dense"))
    return rows.select("doc_id", F.coalesce(U.routing_executed(rows), F.lit(False)).alias("executed"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x,y' ELSE 'c' || doc_id END AS ids FROM documents")
def pr13_chunk_ids(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("retrieved_chunk_ids", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x "), F.lit("y"))))
    return rows.select("doc_id", F.array_join(U.retrieved_chunk_ids(rows), ",").alias("ids"))


@query("SELECT doc_id, NULL::DOUBLE AS lexical_f1, 'skipped_retrieval_only' AS answer_status FROM documents")
def pr19_retrieval_only(spark, sf_dir):
    return U.retrieval_only(table(spark, sf_dir, "documents").select("doc_id"), ["lexical_f1"])


@query("SELECT item_id AS query_id, text AS question, text AS cleaned_question, NULL::VARCHAR AS category, 'orchestration_disabled' AS category_reason, 0e0 AS orchestration_latency_ms FROM benchmark")
def pr20_without_orchestration(spark, sf_dir):
    return U.without_orchestration(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))


@query("""
SELECT unnest(['question_count', 'dataset_status', 'unmapped_records', 'chunk_config', 'strategy', 'chunk_size', 'chunk_overlap']) AS "check",
    unnest([n = m, TRUE, FALSE, TRUE, TRUE, FALSE, TRUE]) AS passed FROM (SELECT count(*) AS n, count(*) AS m FROM documents)""")
def va03_chunk_compatibility(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.lit("C01_sentence256_overlap100").alias("chunk_config_id"), F.lit("Sentence").alias("chunking_strategy"), F.when(F.col("doc_id") % 2 == 0, 256).otherwise(512).alias("chunk_size"), F.lit("100").alias("chunk_overlap"))
    package = docs.agg(F.count("*").alias("questions"), F.count("*").alias("loaded_questions")).withColumns({"chunk_config_id": F.lit("C01_sentence256_overlap100"), "dataset_status": F.lit("PASS"), "unmapped_records": F.lit(3)})
    return U.chunk_compatibility(rows, package)


@query(f"""
WITH r AS ({_RESULTS}), a AS (SELECT max(n) AS top, sum(n) AS n FROM (SELECT count(*) AS n FROM r WHERE answer IS NOT NULL GROUP BY answer))
SELECT unnest(['result_file_missing', 'zero_rows', 'rows_do_not_match_questions', 'repeated_questions', 'metrics_without_rows', 'reported_metrics_differ', 'leakage', 'many_answers_identical', 'nothing_retrieved', 'no_latencies', 'several_models']) AS "check",
    unnest([FALSE, (SELECT count(*) FROM r) = 0, EXISTS (SELECT 1 FROM r GROUP BY experiment_id HAVING count(*) <> 50), EXISTS (SELECT 1 FROM r GROUP BY experiment_id, question_id HAVING count(*) > 1), FALSE, FALSE, TRUE,
        (SELECT n >= 5 AND top >= 0.8 * n FROM a), TRUE, (SELECT bool_and(doc_id % 3 = 0) FROM r), (SELECT count(DISTINCT doc_id % 2) > 1 FROM r)]) AS suspicious""")
def va05_fake_run_checks(spark, sf_dir):
    return U.fake_run_checks(_results(spark, sf_dir), 50, evaluated=10, leaks=1)


@query("""
WITH m AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS run_id, c AS "check", s AS suspicious FROM (
    SELECT k, 'manifest_missing' AS c, TRUE AS s FROM m WHERE k % 7 = 0 UNION ALL SELECT k, 'manifest_unreadable', TRUE FROM m WHERE k % 7 <> 0 AND k % 5 = 0
    UNION ALL SELECT k, 'hash_mismatch', k % 3 = 0 FROM m WHERE k % 7 <> 0 AND k % 5 <> 0 UNION ALL SELECT k, 'question_count_mismatch', k % 4 = 1 FROM m WHERE k % 7 <> 0 AND k % 5 <> 0
    UNION ALL SELECT k, 'impossible_times', k % 11 = 0 OR k % 6 = 0 FROM m WHERE k % 7 <> 0 AND k % 5 <> 0)""")
def va05_manifest_checks(spark, sf_dir):
    k = F.col("s_suppkey")
    return U.manifest_checks(table(spark, sf_dir, "supplier").select(
        k.alias("run_id"), (k % 7 != 0).alias("present"), (k % 5 != 0).alias("readable"), F.when(k % 3 == 0, "aa").when(k % 3 == 1, "bb").alias("expected_sha256"), F.lit("bb").alias("actual_sha256"),
        F.when(k % 4 != 2, 95 + (k % 4 != 1).cast("int")).alias("n_queries"), F.lit(96).alias("result_rows"), F.lit("2026-01-02T10:00:00Z").alias("started"),
        F.when(k % 11 == 0, "2026-01-01T10:00:00Z").when(k % 6 != 0, "2026-01-02T10:00:00Z").alias("ended"),
    ))


@query(f"""
WITH x AS (SELECT question_id, list_concat(
    CASE WHEN NOT diagnosed THEN ['missing_diagnostics'] ELSE CASE WHEN final > 5 THEN ['more_contexts_than_top_k'] ELSE [] END END,
    CASE WHEN experiment_id IS DISTINCT FROM 'src1' THEN ['experiment_id'] ELSE [] END,
    CASE WHEN diagnosed AND NOT applied THEN ['no_reranking'] ELSE [] END,
    CASE WHEN diagnosed AND decision IS NULL THEN ['no_routing_outcome'] WHEN diagnosed AND mode = 'category' AND NOT fallback AND NOT filtered_dense THEN ['no_filter_evidence'] ELSE [] END) AS v FROM ({_RESULTS}))
SELECT question_id, array_to_string(v, ',') AS violations FROM x WHERE len(v) > 0""")
def va08_source_violations(spark, sf_dir):
    made = U.source_violations(_results(spark, sf_dir), experiment="src1", retriever="adaptive_category_aware_hybrid_rrf", top_k=5, hybrid=True, reranker=True, routing=True)
    return made.withColumn("violations", F.array_join("violations", ","))


@query(f"""
WITH r AS (SELECT *, decision IS NOT NULL AND mode <> '' AS routed FROM ({_RESULTS})), s AS (SELECT count(*) AS n, count(*) FILTER (routed) AS routed, count(*) FILTER (routed AND mode = 'category' AND NOT fallback) AS c, sum(dense) AS d, sum(bm25) AS b, sum(fused) AS f, sum(reranked) AS k FROM r)
SELECT unnest(['run_status', 'no_failed_questions', 'rows_present', 'manifest_top_k', 'row_count', 'rows_keep_contract', 'hybrid_evidence', 'reranking_evidence', 'all_rows_routed', 'routes_reconcile']) AS "check",
    unnest([TRUE, TRUE, n > 0, FALSE, TRUE, FALSE, d > 0 AND b > 0 AND f > 0, k > 0, routed = n, FALSE]) AS passed FROM s""")
def va08_source_contract(spark, sf_dir):
    rows = _results(spark, sf_dir)
    manifest = rows.agg(F.count("*").alias("expected_questions")).withColumns({"run_status": F.lit("PASS"), "failed_questions": F.lit(0), "top_k": F.lit(7), "category_route_count": F.lit(-1), "global_route_count": F.lit(0), "fallback_count": F.lit(0)})
    return U.source_contract(rows, manifest, {"top_k": 5}, hybrid=True, reranker=True, routing=True)


@query(f"""
WITH r AS ({_RESULTS}), x AS (
    SELECT 'missing_gold' AS rule, count(*) AS n, 'error' AS severity FROM r WHERE question_id NOT IN (SELECT 'Q' || doc_id FROM labels)
    UNION ALL SELECT 'missing_answer', count(*), 'error' FROM r WHERE answer IS NULL UNION ALL SELECT 'missing_generation_contexts', count(*), 'error' FROM r WHERE doc_id % 14 = 0
    UNION ALL SELECT 'missing_question_text', count(*), 'error' FROM r UNION ALL SELECT 'empty_gold_answers', count(*) FILTER (toxic = 0), 'warning' FROM labels)
SELECT * FROM x WHERE n > 0""")
def va09_input_violations(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select(F.concat(F.lit("Q"), F.col("doc_id")).alias("question_id"), F.when(F.col("toxic") == 0, " ").otherwise("yes").alias("answer"))
    return U.input_violations(_results(spark, sf_dir), gold, table(spark, sf_dir, "benchmark"), official=True)


@query("""
WITH s AS (SELECT source AS experiment_id, count(*) AS n FROM documents GROUP BY source), v AS (SELECT experiment_id, n % 2 = 0 AS run_valid FROM s WHERE n % 3 <> 0), c AS (SELECT experiment_id, n / 7e0 AS score FROM s WHERE n % 5 <> 0)
SELECT s.experiment_id, n, run_valid, round(score, 6) AS score, n AS members, run_valid IS NOT NULL AND score IS NOT NULL AS complete FROM s LEFT JOIN v USING (experiment_id) LEFT JOIN c USING (experiment_id)""")
def va13_experiment_records(spark, sf_dir):
    summary = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("experiment_id")).agg(F.count("*").alias("n"))
    n = F.col("n")
    made = U.experiment_records(summary, summary.where(n % 3 != 0).select("experiment_id", (n % 2 == 0).alias("run_valid")), summary.where(n % 5 != 0).select("experiment_id", (n / 7.0).alias("score")), summary.select("experiment_id", n.alias("members")))
    return made.withColumn("score", six("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN -1 ELSE n_chars END::BIGINT AS n_chars FROM documents")
def va16_repaired_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast(LONG).alias("n_chars"))
    return U.repaired(rows, rows.where(F.col("doc_id") % 10 == 3).withColumn("n_chars", F.lit(-1).cast(LONG)), "doc_id")
