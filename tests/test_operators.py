"""Routing, fusion, parents, evaluation and leaderboard operators on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import evaluation as E
from lodestone.operators import intervals as I
from lodestone.operators import leaderboard as L
from lodestone.operators import retrieval as R
from lodestone.sources import readers, sinks
from lodestone.streaming.events import process_incrementally

HITS = "query_id string, item_id string, score double, rank int"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def test_rrf_adds_both_legs_and_breaks_ties_by_first_seen(spark):
    a = spark.createDataFrame([("q", "c1", 0.9, 1), ("q", "c2", 0.8, 2)], HITS)
    b = spark.createDataFrame([("q", "c2", 5.0, 1), ("q", "c3", 4.0, 2), ("q", " ", 1.0, 3)], HITS)
    got = R.rrf_fuse(a, b, 5).orderBy("rank").collect()
    assert [r.item_id for r in got] == ["c2", "c1", "c3"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    tie = spark.createDataFrame([("q", "x", 5.0, 1)], HITS)
    assert [r.item_id for r in R.rrf_fuse(a.where("rank = 1"), tie, 5).orderBy("rank").collect()] == ["c1", "x"]
    empty = a.where("false")
    assert [r.item_id for r in R.rrf_fuse(empty, b, 5).orderBy("rank").collect()] == ["c2", "c3"]


def test_routing(spark):
    predicted = spark.createDataFrame([("q1", "F"), ("q2", "F"), ("q3", "F")], "query_id string, predicted string")
    probe = spark.createDataFrame([("q1", c, 1.0) for c in "FFFHE"] + [("q2", c, 1.0) for c in "FFHHH"], "query_id string, category string, score double")
    got = {r.query_id: r for r in R.routing_decision(R.probe_support(probe, predicted), 0.5, 3, 1).collect()}
    assert (got["q1"].share, got["q1"].margin, got["q1"].accepted) == (0.6, 2, True)
    assert (got["q2"].rival, got["q2"].rival_count, got["q2"].accepted) == ("H", 3, False)
    assert got["q2"].reason == "category_share_below_threshold,category_count_below_threshold,support_margin_below_threshold"
    assert got["q3"].reason == "empty_global_probe"


def test_category_fallback(spark):
    own = spark.createDataFrame([("q1", "a", 1.0, 1)], HITS)
    every = spark.createDataFrame([("q1", "z", 1.0, 1), ("q2", "z", 1.0, 1), ("q3", "z", 1.0, 1)], HITS)
    routes = spark.createDataFrame([("q1", True), ("q2", True), ("q3", False)], "query_id string, routed boolean")
    got = {r.query_id: (r.item_id, r.retrieval_mode, r.fallback_reason) for r in R.category_or_global(own, every, routes).collect()}
    assert got == {"q1": ("a", "category", None), "q2": ("z", "global", "category_retrieval_empty"), "q3": ("z", "global", "not_routed")}


def test_parents_and_expansion(spark):
    chunks = spark.createDataFrame([(1, "in", 2, 4), (1, "cross", 8, 14), (1, "out", 30, 40)], "doc_id int, item_id string, start int, end int")
    sections = spark.createDataFrame([(1, "A", 0, 20, 1, 0), (1, "B", 0, 10, 2, 1), (1, "C", 10, 20, 2, 2)], "doc_id int, parent_id string, s_start int, s_end int, level int, ordinal int")
    got = {r.item_id: (r.parent_id, r.mapping) for r in I.map_to_parents(chunks, sections).collect()}
    assert got == {"in": ("B", "contained"), "cross": ("A", "contained"), "out": (None, "fallback")}
    hits = spark.createDataFrame(
        [("q", 1, "h1", "t1", [("P", "long", 90), ("S", "short", 5)]), ("q", 2, "h2", "t2", [("P", "long", 90), ("S", "short", 5)]), ("q", 3, "h3", "t3", [("S", "short", 5)]), ("q", 4, "h4", "t4", [])],
        "query_id string, rank int, item_id string, text string, parents array<struct<parent_id:string,text:string,words:int>>",
    )
    out = R.expand_parents(hits, 10, 5).orderBy("rank").collect()
    assert [(r.item_id, r.parent_id, r.kind) for r in out] == [("h1", "S", "smaller_parent"), ("h2", "S", "smaller_parent"), ("h4", None, "child")]


def test_budget_and_selection(spark):
    texts = spark.createDataFrame([("q", 1, "aa"), ("q", 2, " "), ("q", 3, "b" * 50), ("q", 4, "c")], "query_id string, rank int, text string")
    assert rows(R.within_budget(texts, 10, 10), "rank") == [(1,)]
    ranked = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "a", 1.0, 2), ("q", "b", 1.0, 3), ("q", "c", 1.0, 4)], HITS)
    got = R.select_unique(ranked, 3, 2).orderBy("rank").collect()
    assert [(r.item_id, r.refilled) for r in got] == [("a", False), ("b", True), ("c", True)]
    with pytest.raises(Exception, match="finite"):
        R.rerank(ranked, F.lit(float("nan"))).collect()


def test_evaluation(spark):
    assert rows(L.competition_rank(spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 2.0), ("d", None)], "id string, s double"), "s"), "id", "rank") == [("a", 1), ("b", 3), ("c", 1), ("d", None)]
    data = spark.createDataFrame([("x", None), ("x", 1.0), ("y", None)], "g string, m double")
    assert rows(E.summarize(data, "g", ["m"]), "g", "n", "mean_m") == [("x", 2, 1.0), ("y", 1, None)]
    cells = E.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None)], "g string, p string"), "g", "p")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in E.class_scores(cells).collect()}
    assert got == {"a": (1, 0, 1), "b": (0, 1, 1), "unknown": (0, 1, 0)}
    log = spark.createDataFrame([("Q2", 1, None, "x"), ("Q2", 2, "err", ""), ("Q10", 3, None, "y"), ("zz", 4, None, "z"), ("Q10", 5, None, "w")], "question_id string, write_seq int, error string, generated_answer string")
    done = E.reconcile(log, "question_id", "write_seq", sinks.valid_result(F.col("error"), F.col("question_id"), F.col("generated_answer")))
    assert [(r.question_id, r.generated_answer) for r in done.orderBy(*E.question_order(F.col("question_id"))).collect()] == [("Q2", "x"), ("Q10", "w"), ("zz", "z")]


def test_sources_and_sinks(spark, tmp_path):
    kb = tmp_path / "kb.jsonl"
    kb.write_text('﻿{"doc_key": "d1", "text": "one", "doc_name": "n"}\n\n{"doc_id": "d2", "text": "two", "quellpfad": "p"}\n', encoding="utf-8")
    assert rows(readers.read_documents(spark, str(kb)), "document_id", "text") == [("d1", "one"), ("d2", "two")]
    kb.write_text("{broken\n")
    with pytest.raises(Exception, match="JSON"):
        readers.read_documents(spark, str(kb)).collect()
    q = tmp_path / "q.jsonl"
    q.write_text(json.dumps({"question_id": "Q1", "frage": "was?"}) + "\n")
    assert rows(readers.read_questions(spark, str(q)), "question_id", "question") == [("Q1", "was?")]
    q.write_text(json.dumps({"question_id": "Q1", "frage": "was?", "answer": "x"}) + "\n")
    with pytest.raises(Exception, match="answers"):
        readers.read_questions(spark, str(q)).collect()
    gold = tmp_path / "gold.jsonl"
    gold.write_text("\n".join(json.dumps({"question_id": "Q1", "gold_relevant_chunk_ids": c}) for c in (["a ", "b"], ["b"])))
    assert rows(readers.read_gold_chunks(spark, str(gold)), "question_id", "chunk_id") == [("Q1", "a"), ("Q1", "b")]
    folder = tmp_path / "txt" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("hello\nworld")
    (folder / "b.txt").write_text("  ")
    assert rows(readers.read_text_folder(spark, str(tmp_path / "txt")), "document_id", "text") == [("sub/a.txt", "hello\nworld")]
    df = spark.range(5)
    assert sinks.fingerprint(df, "id") == sinks.fingerprint(df.repartition(3), "id") != sinks.fingerprint(spark.range(4), "id")
    built = [sinks.cached(spark, str(tmp_path), "key", lambda: df).count() for _ in range(2)]
    assert built == [5, 5]


def test_models_and_stream(spark, tmp_path):
    prompts = spark.createDataFrame([("a", "ctx. One. Two."), ("b", None)], "query_id string, prompt string")
    assert rows(models.generate(prompts), "query_id", "answer", "error") == [("a", "ctx.", None), ("b", "", None)]

    def fails(_):
        raise ValueError("down")

    assert rows(models.generate(prompts, fails, 2), "query_id", "error", "tries") == [("a", "ValueError: down", 2), ("b", "ValueError: down", 2)]
    good = json.dumps({"correctness": 5, "faithfulness": 4.0, "completeness": 3, "hallucination": 0, "context_relevance": 2, "overall_score": 4, "reasoning": "r"})
    judged = spark.createDataFrame([("```json\n" + good + "\n```",), ("nothing",), (good.replace("5", "9", 1),)], "r string").select(models.parse_judgement(F.col("r")).alias("j"))
    assert [r.j.success for r in judged.collect()] == [True, False, False]
    src = tmp_path / "in"
    spark.createDataFrame([("Q1", "x")], "question_id string, question string").write.json(str(src))
    stream = spark.readStream.schema("question_id string, question string").json(str(src))
    for _ in range(2):  # again: nothing is answered twice
        process_incrementally(stream, lambda b: b.withColumn("answer", F.lit("a")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_memory_of_a_unit_does_not_grow_with_its_vectors():
    """Batches of one unit pass one by one: a hundred thousand vectors take no more than a few batches; the hits are those of all at once, ties by item."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, dim, k = np.random.default_rng(3), 16, 7
    q, v = rng.integers(-2, 3, (40, dim)).astype(float), rng.integers(-2, 3, (100_000, dim)).astype(float)

    def batch(side, ids, x):
        n, none = len(x), pa.nulls(len(x), pa.int64())
        vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, pa.array(x.ravel()))
        ids = pa.array(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, side)), none if side else ids, ids if side else none, vectors], names=["u", "side", "query_id", "item_id", "x"])

    def batches():
        yield batch(0, np.arange(40), q)
        for lo in range(0, len(v), 2000):
            yield batch(1, 500_000 - np.arange(lo, lo + 2000), v[lo : lo + 2000])

    tracemalloc.start()
    made = pa.Table.from_batches(list(R._block_top_k(k, "dot", 1)(batches())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.round(q @ v.T, 9)
    ids = 500_000 - np.arange(len(v))
    want = [(i, int(ids[at])) for i in range(40) for at in np.lexsort((ids, -scores[i]))[:k]]
    assert list(zip(made["query_id"].to_pylist(), made["item_id"].to_pylist(), strict=True)) == want
    assert peak < 40e6


def test_more_hits_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_HITS", 100)
    hits = spark.range(3000).selectExpr("id % 500 AS query_id", "id AS item_id", "cast(id AS double) AS score")
    dealt = R.top_k(R.by_query(hits), 3)
    assert dealt.rdd.getNumPartitions() == 30
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, R.top_k(hits, 3).collect()))


def test_routes_rank_the_category_leg_once(spark):
    hits = spark.range(60).selectExpr("id % 6 AS query_id", "id AS item_id", "cast(id AS double) AS score")
    routes = spark.range(6).selectExpr("id AS query_id", "id % 2 = 0 AS routed")
    made = R.category_or_global(R.top_k(hits.where("item_id % 3 = 0"), 5), R.top_k(hits, 5), routes, least=2)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
