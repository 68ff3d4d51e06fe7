"""Registered queries of record expressions, list metrics, chunk bookkeeping, fusion and filters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import LONG, _index, _LEGS, _named, _questions, query, six, table
from lodestone.functions import metrics as M
from lodestone.functions import models as X
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import evaluation as E
from lodestone.operators import leaderboard as L
from lodestone.operators import prompts as P
from lodestone.operators import retrieval as R
from lodestone.sources import reports as S
from lodestone.sources import sinks as K

# ---------------------------------------------------------------- fusion, filters, routing


@query(f"""{_LEGS}, docs AS (SELECT doc_id, source FROM documents),
m1 AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s1 JOIN docs USING (doc_id) WHERE source = 'src' || (item_id % 20)) WHERE rank <= 20),
m2 AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s2 JOIN docs USING (doc_id) WHERE source = 'src' || (item_id % 20)) WHERE rank <= 20),
fused AS (SELECT item_id, doc_id, coalesce(0.7e0 / (60 + m1.rank), 0) + coalesce(0.3e0 / (60 + m2.rank), 0) AS score, m1.rank AS r1, m2.rank AS r2 FROM m1 FULL JOIN m2 USING (item_id, doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, r1 IS NULL, coalesce(r1, r2), doc_id) AS rank FROM fused)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5""")
def rt11_category_rrf(spark, sf_dir):
    """Both legs are held to the query's category before they are cut."""
    q, index = _questions(spark, sf_dir), _index(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    among = q.select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("source")).join(docs, "source").select("query_id", "item_id")
    return _named(R.rrf_fuse(R.bm25_top_k(q, index, 20, k1=0.5, b=0.1, among=among), R.bm25_top_k(q, index, 20, among=among), 5, weights=(0.7, 0.3)))


@query("""
WITH r AS (SELECT c_custkey AS q, c_nationkey AS total, c_custkey % 7 AS n, c_custkey % 4 AS rival FROM customer),
f AS (SELECT *, concat_ws(',', CASE WHEN (CASE WHEN total > 0 THEN n / total ELSE 0 END) < 0.3 THEN 'category_share_below_threshold' END, CASE WHEN n < 3 THEN 'category_count_below_threshold' END, CASE WHEN n - rival < 1 THEN 'support_margin_below_threshold' END) AS x FROM r)
SELECT q AS query_id, CASE WHEN total = 0 THEN 'empty_global_probe' WHEN x = '' THEN 'thresholds_satisfied' ELSE x END AS reason, total > 0 AND x = '' AS accepted FROM f""")
def rt16_routing_decision(spark, sf_dir):
    k = F.col("c_custkey")
    support = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.col("c_nationkey").alias("total"), (k % 7).alias("predicted_count"), F.when(F.col("c_nationkey") > 0, k % 7 / F.col("c_nationkey")).otherwise(0.0).alias("share"), (k % 7 - k % 4).alias("margin"))
    return R.routing_decision(support, 0.3, 3, 1).select("query_id", "reason", "accepted")


@query("""
WITH c AS (SELECT l_orderkey AS q, l_linenumber AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rank FROM lineitem WHERE l_linenumber % 2 = 0),
n AS (SELECT o_orderkey AS q, o_orderkey % 3 <> 0 AS routed, (SELECT count(*) FROM c WHERE c.q = o_orderkey) AS n FROM orders), p AS (SELECT *, routed AND n >= 2 AS own FROM n)
SELECT q AS query_id, i AS item_id, rank, 'category' AS retrieval_mode, NULL AS fallback_reason FROM c JOIN p USING (q) WHERE own
UNION ALL SELECT q, l_linenumber, row_number() OVER (PARTITION BY q ORDER BY l_linenumber), 'global', CASE WHEN NOT routed THEN 'not_routed' WHEN n = 0 THEN 'category_retrieval_empty' ELSE 'insufficient_category_results' END FROM lineitem JOIN p ON q = l_orderkey WHERE NOT own""")
def rt14_category_or_global(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("item_id"), (-F.col("l_linenumber")).cast("double").alias("score"))
    lines = R.by_query(lines)
    routes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 3 != 0).alias("routed"))
    made = R.category_or_global(R.top_k(lines.where("item_id % 2 = 0"), 99), R.top_k(lines, 99), routes, least=2)
    return made.select("query_id", "item_id", F.col("rank").cast(LONG).alias("rank"), "retrieval_mode", "fallback_reason")


@query("""
WITH h AS (SELECT user_id AS q, event_id AS i, value AS s, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) AS r FROM events)
SELECT q AS query_id, i AS item_id, r::BIGINT AS first_rank, row_number() OVER (PARTITION BY q ORDER BY round((i % 5)::DOUBLE + 0.5e0 * (i % 2), 9) DESC, r, i) AS rank FROM h WHERE r <= 5""")
def rt20_rerank(spark, sf_dir):
    i = F.col("item_id")
    hits = R.top_k(table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.col("value").alias("score")), 5)
    return R.rerank(hits, (i % 5).cast("double"), 0.5 * (i % 2)).select("query_id", "item_id", F.col("first_rank").cast(LONG).alias("first_rank"), F.col("rank").cast(LONG).alias("rank"))


@query("SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 0.5e0 ELSE 0 END + CASE WHEN lang = 'de' THEN 0.25e0 ELSE 0 END) AS boost FROM documents")
def pr03_metadata_boost(spark, sf_dir):
    boosts = R.metadata_boost({"even": (F.col("doc_id") % 2 == 0, 0.5), "german": (F.col("lang") == "de", 0.25), "off": (F.lit(True), 0.0)})
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(F.map_values(boosts), F.lit(0.0), lambda s, x: s + x).alias("boost"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang IS NOT DISTINCT FROM 'de' OR (doc_id % 3 = 2 AND lang IS NOT DISTINCT FROM 'en') END AS matches FROM documents")
def pr04_match_flags(spark, sf_dir):
    signals = F.slice(F.array(F.lit("de"), F.lit("en")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", R.match_flags(signals, F.col("lang")).alias("matches"))


# ---------------------------------------------------------------- record expressions


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'clean ' || doc_id WHEN 3 THEN source ELSE source END AS cleaned_question, CASE WHEN doc_id % 4 = 0 THEN lang END AS detected_category, CASE doc_id % 4 WHEN 1 THEN 'answers the question' WHEN 2 THEN 'no object' WHEN 3 THEN NULL END AS error FROM documents""")
def pr07_orchestration_reply(spark, sf_dir):
    i = F.col("doc_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit('Sure: {"cleaned_question": "clean '), i, F.lit('", "detected_category": "'), F.coalesce("lang", F.lit("")), F.lit('"} done'))).when(i % 4 == 1, '{"answer": "42", "detected_category": "x"}').when(i % 4 == 2, "I can't").otherwise('{"detected_category": " "}')
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_orchestration(reply, F.col("source")).alias("r")).select("doc_id", "r.*")


@query("SELECT event_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM events")
def pr09_valid_result(spark, sf_dir):
    i = F.col("event_id")
    ok = K.valid_result(F.when(i % 3 == 0, "boom"), F.when(i % 5 == 0, " ").otherwise("Q1"), F.when(i % 7 == 0, "").otherwise("yes"))
    return table(spark, sf_dir, "events").select("event_id", ok.alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND source <> '' THEN source WHEN doc_id % 3 = 0 AND lang <> '' THEN lang ELSE 'd' || doc_id END AS id FROM documents")
def pr14_first_identifier(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.first_truthy(F.when(i % 2 == 0, F.col("source")).otherwise(""), F.when(i % 3 == 0, F.col("lang")), F.concat(F.lit("d"), i)).alias("id"))


@query("SELECT doc_id, CASE WHEN h = '' THEN 'body' ELSE '[' || h || ']' || chr(10) || 'body' END AS context FROM (SELECT doc_id, concat_ws(' | ', 'Document: ' || source, CASE WHEN doc_id % 2 = 0 THEN 'Category: ' || lang END) AS h FROM documents)")
def pr15_context_header(spark, sf_dir):
    made = P.context_with_header(F.lit("body"), {"doc_name": F.col("source"), "category": F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ")})
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("context"))


@query("SELECT l_orderkey AS query_id, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS cited FROM lineitem GROUP BY l_orderkey")
def pr17_citations(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("item_id"))
    made = P.citations(hits, ["item_id", "absent"])
    return made.select("query_id", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["rank"], c["item_id"])), ",").alias("cited"))


# ---------------------------------------------------------------- list and answer metrics

_LISTS = """SELECT doc_id, list_transform([0, 3, 1, 3, 2, 8, 1], lambda i: CASE WHEN (doc_id + i) % 9 = 8 THEN ' ' ELSE ((doc_id + i) % 7)::VARCHAR END) AS r, list_transform(range(doc_id % 4), lambda i: ((doc_id * 3 + i) % 9)::VARCHAR) AS g FROM documents"""


def _lists(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    item = lambda n: F.when((i + n) % 9 == 8, " ").otherwise(((i + n) % 7).cast("string"))
    gold = F.transform(F.when(i % 4 > 0, F.sequence(F.lit(0).cast(LONG), i % 4 - 1)).otherwise(F.array().cast("array<bigint>")), lambda n: ((i * 3 + n) % 9).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array(*[item(n) for n in (0, 3, 1, 3, 2, 8, 1)]).alias("r"), gold.alias("g"))


@query(f"""
WITH x AS ({_LISTS}), n AS (SELECT doc_id, g, unnest(r) AS v, generate_subscripts(r, 1) AS i FROM x), f AS (SELECT doc_id, any_value(g) AS g, v, min(i) AS i FROM n WHERE trim(v) <> '' GROUP BY doc_id, v),
o AS (SELECT doc_id, g, v, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f), h AS (SELECT doc_id, len(list_distinct(any_value(g))) AS n, min(p) FILTER (list_contains(g, v) AND p <= 3) AS first, count(*) FILTER (list_contains(g, v) AND p <= 3) AS hits, coalesce(sum(1 / log2(p + 1)) FILTER (list_contains(g, v) AND p <= 3), 0) AS dcg FROM o GROUP BY doc_id)
SELECT doc_id, (hits > 0)::INT::DOUBLE AS hit, round(CASE WHEN n > 0 THEN hits / n END, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 3) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM h""")
def mx02_distinct_metrics(spark, sf_dir):
    made = M.distinct_rank_metrics(F.col("r"), F.col("g"), 3)
    return _lists(spark, sf_dir).select("doc_id", *[six(c).alias(n) for n, c in made.items()])


@query(f"WITH x AS ({_LISTS}) SELECT doc_id, (5 - len(list_distinct(r[1:5])))::BIGINT AS duplicates, round((5 - len(list_distinct(r[1:5]))) / 5, 6) AS rate_at_5, round((7 - len(list_distinct(r))) / 7, 6) AS raw_rate FROM x")
def mx04_duplicate_rates(spark, sf_dir):
    made = M.rank_metrics(F.col("r"), F.col("g"), 5)
    return _lists(spark, sf_dir).select("doc_id", made["duplicates"].alias("duplicates"), six(made["duplicate_rate"]).alias("rate_at_5"), six(M.duplicate_rate(F.col("r"))).alias("raw_rate"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND trim(lang) <> '' THEN (lower(lang) = CASE WHEN doc_id % 5 = 0 THEN 'de' ELSE lower(lang) END)::INT::DOUBLE END AS accuracy, doc_id % 7 = 0 AS unknown, doc_id % 4 = 0 OR doc_id % 6 = 0 AS failed FROM documents")
def mx13_answer_flags(spark, sf_dir):
    i = F.col("doc_id")
    predicted = F.when(i % 3 > 0, F.when(i % 5 == 0, "DE ").otherwise(F.upper("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", M.category_accuracy(predicted, F.col("lang")).alias("accuracy"), M.is_unknown(F.when(i % 7 == 0, " Unbekannt").otherwise("unknown to us")).alias("unknown"), M.generation_failed(F.when(i % 4 == 0, "boom"), F.when(i % 6 == 0, False), F.lit("x")).alias("failed"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS f1 FROM documents")
def mx10_token_scores(spark, sf_dir):
    """Equal texts match whole, a blank one not at all."""
    scored = X.token_scorer()(F.when(F.col("doc_id") % 3 == 0, F.lit("steel prices rise")), F.lit("Steel prices rise"))
    return table(spark, sf_dir, "documents").select("doc_id", scored.alias("s")).select("doc_id", six("s.f1").alias("f1"))


@query(r"SELECT doc_id, n AS tokens, n > 20 AS truncated, round((n * 0.5e0 + 10 * 1.5e0) / 1000, 6) AS cost FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n FROM documents)")
def mx23_token_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.token_counter()(F.col("text")).alias("tokens"), X.token_truncator(20)(F.col("text")).alias("t"))
    return docs.select("doc_id", "tokens", F.col("t.truncated").alias("truncated"), six(X.estimated_cost(F.col("tokens"), F.lit(10), 0.5, 1.5)).alias("cost"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 6)::INT END AS correctness, doc_id % 3 = 0 AS success FROM documents""")
def mx20_judgement(spark, sf_dir):
    i = F.col("doc_id")
    scores = F.concat(F.lit('{"correctness": '), i % 6, F.lit(', "faithfulness": 3, "completeness": 4, "hallucination": 0, "context_relevance": 5, "overall_score": 4, "reasoning": "fine"}'))
    reply = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), scores, F.lit("\n```"))).when(i % 3 == 1, F.regexp_replace(scores, '"faithfulness": 3', '"faithfulness": 9')).otherwise("no")
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_judgement(reply).alias("j")).select("doc_id", "j.correctness", "j.success")


@query("SELECT doc_id, 'Q: ' || to_json(source) || ' in ' || coalesce(to_json(lang), 'null') AS prompt FROM documents")
def mx25_json_placeholders(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.fill_json("Q: {{source_json}} in {{lang_json}}", {"source": F.col("source"), "lang": F.col("lang")}).alias("prompt"))


@query(r"SELECT doc_id, length(a) > 50 AS truncated, 'Question:' || chr(10) || source || chr(10) || 'Contexts:' || chr(10) || substring(a, 1, 50) || chr(10) || 'Answer:' || chr(10) || chr(10) || 'Reference answer:' || chr(10) || 'gold' || chr(10) || 'Reply with one JSON object of scores from 0 to 5 and a reasoning.' AS prompt FROM (SELECT doc_id, source, '[1] ' || source || chr(10) || chr(10) || '[2] ' || text AS a FROM documents)")
def mx26_judge_prompt(spark, sf_dir):
    made = X.judge_prompt(F.col("source"), F.lit(None).cast("string"), F.array("source", "text"), F.lit("gold"), 50)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("p")).select("doc_id", "p.prompt", "p.truncated")


# ---------------------------------------------------------------- chunk bookkeeping


@query("SELECT doc_id, 'k' || doc_id || ':chunk:' || lpad((doc_id % 7 + 1)::VARCHAR, 4, '0') AS keyed, doc_id || ':3-9' AS positioned, sha256(doc_id || ':3:9:' || source) AS hashed FROM documents")
def ch10_chunk_ids(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", C.keyed_chunk_id(F.concat(F.lit("k"), i), (i % 7).cast("int")).alias("keyed"), C.position_chunk_id(i, F.lit(3), F.lit(9)).alias("positioned"), C.hashed_chunk_id(i, F.lit(3), F.lit(9), F.col("source")).alias("hashed"))


@query("SELECT doc_id, source AS doc_name, CASE WHEN doc_id % 2 = 0 THEN 'chunk' ELSE 'doc' END AS title, '4' AS ordinal FROM documents")
def ch11_chunk_metadata(spark, sf_dir):
    document = F.create_map(F.lit("doc_name"), F.col("source"), F.lit("title"), F.lit("doc"), F.lit("ordinal"), F.lit("0"))
    chunk = F.create_map(F.lit("title"), F.when(F.col("doc_id") % 2 == 0, "chunk").otherwise(" "), F.lit("ordinal"), F.lit("1"))
    made = table(spark, sf_dir, "documents").select("doc_id", C.merged_metadata(document, chunk, ordinal=F.lit(4)).alias("m"))
    return made.select("doc_id", *[F.col("m")[k].alias(k) for k in ("doc_name", "title", "ordinal")])


@query("SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS unit, count(*) AS n FROM documents GROUP BY ALL")
def ch13_unit_counts(spark, sf_dir):
    return C.unit_counts(table(spark, sf_dir, "documents"), "lang")


@query(r"""
WITH w AS (SELECT doc_id, text, n, s, least(s + 50, n) AS e FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 50 THEN least(length(text), 1) ELSE 40 * ceil((length(text) - 50) / 40e0)::BIGINT + 1 END, 40)) AS s FROM documents)),
b AS (SELECT doc_id, s, text[s + 1:e] AS body FROM w)
SELECT doc_id, s + length(body) - length(regexp_replace(body, '^\s+', '')) AS start, regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '') AS text FROM b WHERE regexp_matches(body, '\S')""")
def ch18_token_ranges(spark, sf_dir):
    """Characters as tokens: what a range covers is the text it stands for."""
    chunk = lambda t: C.token_char_ranges(t, 50, 10, lambda x: [(i, i + 1) for i in range(len(x))])
    return C.chunk_documents(table(spark, sf_dir, "documents"), chunk).select("doc_id", "start", "text")


# ---------------------------------------------------------------- reports, eligibility, verdicts


@query("SELECT source AS experiment_id, count(*) AS n, round(avg(doc_id % 2), 6) AS \"hit@1\", NULL::DOUBLE AS \"recall@5\" FROM documents GROUP BY source")
def sk08_compact_summary(spark, sf_dir):
    summary = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("experiment_id")).agg(F.count("*").alias("n"), six(F.avg(F.col("doc_id") % 2)).alias("mean_hit_at_1"))
    return S.compact_summary(summary, [1, 5]).select("experiment_id", "n", "`hit@1`", "`recall@5`")


@query("SELECT 's' || s_suppkey AS experiment_id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey::VARCHAR ELSE '' END AS rank, printf('%.6f', s_acctbal::DOUBLE) AS score, '' AS note FROM supplier")
def sk10_leaderboard(spark, sf_dir):
    k = F.col("s_suppkey")
    records = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("experiment_id"), F.when(k % 4 > 0, k).alias("rank"), F.col("s_acctbal").cast("double").alias("score"), F.lit(None).cast("string").alias("note"))
    return S.leaderboard(records, "rank", ["experiment_id", "rank", "score", "note"])


@query("""
SELECT s_suppkey AS run, CASE WHEN s_suppkey % 5 = 0 THEN 'NOT_AVAILABLE' WHEN s_suppkey % 3 = 0 THEN 'INCOMPLETE' WHEN s_suppkey % 2 = 0 THEN 'JUDGE_WARNING' ELSE 'VALID' END AS semantic_status, s_suppkey % 7 = 0 AS nan_warning FROM supplier""")
def va11_semantic_eligibility(spark, sf_dir):
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(k.alias("run"), (k % 5 != 0).alias("available"), F.when(k % 3 == 0, 1).otherwise(0).alias("missing_metrics"), F.when(k % 2 == 0, 0.8).otherwise(1.0).alias("judge_success_rate"), F.when(k % 7 == 0, 0.5).alias("nan_rate"))
    return L.semantic_eligibility(runs, 0.95, 0.1).select("run", "semantic_status", "nan_warning")


@query("SELECT s_suppkey AS run, CASE WHEN s_suppkey % 5 = 0 THEN 'invalid' WHEN s_suppkey % 3 = 0 THEN 'partially_valid' ELSE 'valid' END AS verdict FROM supplier")
def va07_verdict(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("run"), E.verdict(k % 5 == 0, k % 3 == 0).alias("verdict"))


@query("SELECT doc_id::VARCHAR AS id, 'missing_section' AS rule FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT source, 'repeated_section' FROM documents GROUP BY source HAVING count(*) > 1")
def sc18_parent_store(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mapping = docs.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 3 == 0, "nowhere").otherwise(F.col("source")).alias("parent_id"))
    return S.parent_store_violations(mapping, docs.select(F.col("source").alias("parent_id")))


@query("SELECT doc_id AS question_id, source, quality, NULL::VARCHAR AS answer, quality IS NOT NULL AS gold_available FROM documents LEFT JOIN labels USING (doc_id)")
def sc08_semantic_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "source")
    gold = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("question_id"), "quality")
    return S.semantic_inputs(docs, docs, docs.select("question_id", F.lit(None).cast("string").alias("answer")), gold).select("question_id", "source", "quality", "answer", "gold_available")


@query("SELECT s_suppkey AS run_id, 'aa' AS sha256, CASE WHEN s_suppkey % 2 = 0 THEN 'aa' WHEN s_suppkey % 5 <> 0 THEN 'bb' END AS sha256_now, CASE WHEN s_suppkey % 2 = 0 THEN 'unchanged' WHEN s_suppkey % 5 = 0 THEN 'skipped' ELSE 'changed' END AS state FROM supplier")
def va19_linked_runs(spark, sf_dir):
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(k.alias("run_id"), F.when(k % 2 == 0, "aa").otherwise("bb").alias("sha256"))
    return S.linked_runs(runs.withColumn("sha256", F.lit("aa")), runs.where((F.col("run_id") % 2 == 0) | (F.col("run_id") % 5 != 0)))
