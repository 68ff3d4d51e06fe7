"""Whole runs over a small corpus."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.config import RetrievalSettings, load_settings
from lodestone.operators.prompts import citations, context_with_header
from lodestone.plans.pipelines import answer, evaluate, rank_experiments, retrieve, summarize_run

CHUNKS = [("c1", "steel prices rise. more text", "a"), ("c2", "copper prices fall. other text", "a"), ("c3", "holiday rules for staff. see list", "b"), ("c4", "steel steel steel", "b")]
QUESTIONS = [("q1", "steel prices", "a"), ("q2", "holiday rules", "b"), ("q3", "nothing known", None)]


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(QUESTIONS, "query_id string, question string, category string"), spark.createDataFrame(CHUNKS, "item_id string, text string, category string")


@pytest.mark.parametrize("kind", ["bm25", "dense", "hybrid", "category", "adaptive"])
def test_retrievers(frames, kind):
    q, c = frames
    got = retrieve(q, c, RetrievalSettings(retriever=kind, top_k=2, minimum_category_count=1, minimum_category_share=0.1, minimum_margin=-5)).collect()
    first = {r.query_id: r.item_id for r in got if r["rank"] == 1}
    assert first["q1"] in ("c1", "c4")
    assert first["q2"] == "c3"
    assert max(r["rank"] for r in got) <= 2


def test_answer_and_evaluate(spark, frames):
    q, c = frames
    results = answer(q, c, RetrievalSettings(retriever="bm25", top_k=2))
    gold = spark.createDataFrame([("q1", ["c1"], "steel prices rise."), ("q2", ["c3"], ""), ("q3", [], None)], "query_id string, gold_ids array<string>, gold_answer string")
    rows = {r.query_id: r for r in evaluate(results, gold).collect()}
    assert rows["q1"].hit_at_3 == rows["q2"].hit_at_1 == 1
    assert rows["q3"].recall_at_1 is None
    assert rows["q2"].match_status == "no_gold"
    one = summarize_run(evaluate(results, gold), "e1", 0.5).first()
    assert (one.n, one.experiment_id) == (3, "e1")
    assert one.mean_recall_at_3 == 1


def test_leaderboard(spark):
    runs = spark.createDataFrame(
        [(f"e{i}", 96, 96, 96, 96, True, "valid", True, False, True, 0, 0, True, 0.0 if i else 0.5, 0.3 + 0.05 * i, 0.3, 0.3, "qa") for i in range(4)],
        "experiment_id string, expected_questions int, n_questions int, evaluated_rows int, source_rows int, manifest_present boolean, final_verdict string, strict_audit_pass boolean, fake_run_suspicious boolean, "
        "outputs_present boolean, duplicate_questions int, distinct_questions int, run_valid boolean, failure_rate double, mean_ndcg_at_5 double, mean_recall_at_5 double, mean_mrr_at_5 double, qa_hash string",
    )
    sem = spark.createDataFrame([("e3", 0.5, 0.5, 0.5, 4.0, 4.0, 4.0, 4.0)], "experiment_id string, mean_bertscore double, mean_similarity double, mean_ragas_faithfulness double, mean_judge_faithfulness double, mean_judge_correctness double, mean_judge_context double, mean_judge_completeness double")
    got = {r.experiment_id: (r.retrieval_rank, r.quality_rank, r.status) for r in rank_experiments(runs, sem, ["qa_hash"]).collect()}
    assert got == {"e0": (None, None, "excluded_failure_rate"), "e1": (3, None, "valid"), "e2": (2, None, "valid"), "e3": (1, 1, "valid")}


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"retrieval": {"top_k": 3, "fetch_k": 9}}))
    (tmp_path / "own.json").write_text(json.dumps({"extends": "base.json", "retrieval": {"top_k": 4}}))
    assert load_settings(tmp_path / "own.json") == {"retrieval": {"top_k": 4, "fetch_k": 9}}
    (tmp_path / "bad.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="repeated"):
        load_settings(tmp_path / "bad.json")
    with pytest.raises(ValueError, match="unknown settings"):
        RetrievalSettings.of({"topk": 1})
    with pytest.raises(ValueError, match="fetch_k"):
        RetrievalSettings.of({"top_k": 50})


def test_prompt_parts(spark):
    row = spark.range(1).select(context_with_header(F.lit("body"), {"doc_name": F.lit("d"), "category": F.lit(" "), "section": F.lit("s")}).alias("c")).first()
    assert row.c == "[Document: d | Section: s]\nbody"
    hits = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a")], "query_id string, rank int, item_id string")
    assert [c.item_id for c in citations(hits, ["item_id", "nope"]).first().citations] == ["a", "b"]
