"""Settings, reports, sinks, model hooks and run checks that have no query of their own."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import models as X
from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.operators import patterns as N
from lodestone.operators import runs as U
from lodestone.operators.chunking import token_char_ranges
from lodestone.operators.leaderboard import competition_rank
from lodestone.plans.pipelines import answer, retrieve
from lodestone.sources import reports as S
from lodestone.sources import sinks as K

CHUNKS = [("c1", "Die Stahlpreise steigen stark", "a"), ("c2", "Kupferpreise fallen", "a"), ("c3", "Urlaubsregeln der Mitarbeiter", "b"), ("c4", "Stahl und Stahlpreis im Lager", "b")]
QUESTIONS = [("q1", "Stahlpreis", "a"), ("q2", "Regeln für den Mitarbeiter", "b"), ("q3", "gar nichts", None)]


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(QUESTIONS, "query_id string, question string, category string"), spark.createDataFrame(CHUNKS, "item_id string, text string, category string")


def test_german_words(spark):
    words = {"preise": "preis", "stahlpreise": "stahlpreis", "häuser": "haus", "mitarbeitern": "mitarbeit", "regeln": "regeln", "größten": "grosst", "tisch": "tisch"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.german_stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words
    row = spark.range(1).select(T.german_tokens(F.lit("Die Preise der großen Häuser, und meine")).alias("t")).first()
    assert row.t == ["preis", "gross", "haus"]
    assert {"der", "die", "das", "eine", "keinem", "welches"} <= set(T.GERMAN_STOP_WORDS)


@pytest.mark.parametrize("name", sorted(config.RETRIEVERS))
def test_every_retriever(frames, name):
    q, c = frames
    s = config.RetrievalSettings.of({"retriever": name, "top_k": 2, "minimum_category_count": 1, "minimum_category_share": 0.1, "minimum_margin": -5})
    got = retrieve(q, c, s).collect()
    assert max(r["rank"] for r in got) <= 2
    if s.analyzer == "german" and s.retriever != "dense":
        assert {r.item_id for r in got if r.query_id == "q1"} <= {"c1", "c2", "c4"}
        assert "c3" in {r.item_id for r in got if r.query_id == "q2"}
    if s.retriever == "adaptive_hybrid":
        modes = {r.query_id: r.retrieval_mode for r in got}
        assert modes["q1"] == "category"


def test_boost_filter_and_fetch(frames):
    q, c = frames
    s = config.RetrievalSettings(retriever="dense", top_k=1, fetch_k=4)
    boosted = retrieve(q, c, s, boost=lambda h: F.when(F.col("item_id") == "c3", 5.0).otherwise(0.0)).collect()
    assert {r.item_id for r in boosted} == {"c3"}
    held = retrieve(q, c, s, keep=lambda h: F.col("item_id") == "c2").collect()
    assert {r.item_id for r in held} == {"c2"}


def test_answer_with_reranker_dedupe_and_parents(spark, frames):
    q, c = frames
    s = config.RetrievalSettings(retriever="dense", top_k=2, fetch_k=4, rerank_top_k=3, dedupe_by="category")
    score = X.pair_scorer(lambda qs, ts: [float(len(t)) for t in ts])
    parents = spark.createDataFrame([("c3", [("p", "Die ganze Regel. Mehr.", 4)])], "item_id string, parents array<struct<parent_id:string,text:string,words:int>>")
    rows = {r.query_id: r for r in answer(q, c, s, reranker=lambda a, b: score(a, b), parents=parents).collect()}
    assert rows["q1"].n_retrieved == 2
    assert set(rows["q1"].retrieved_chunk_ids) == {"c1", "c3"} or len(set(rows["q1"].retrieved_chunk_ids)) == 2


def test_blocks_of_vectors_match_all_pairs(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6)).round(3)
    rows = [(i, v.tolist(), str(i % 3)) for i, v in enumerate(x)] + [(200, None, "0"), (201, [], "0"), (202, [0.0] * 6, "1"), (203, [1.0, 2.0], "1"), (204, x[3].tolist(), "0")]
    v = spark.createDataFrame(rows, "item_id long, vector array<double>, g string")
    q = v.where("item_id % 7 = 0 and item_id < 200").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"), "g")
    monkeypatch.setattr(R, "QUERY_BLOCK", 5)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 20)

    def plain(metric, a, b):
        if b is None or len(b) != len(a):
            return 0.0
        b = np.array(b)
        if metric == "dot":
            return float(a @ b)
        if metric == "l2":
            return -float(np.sqrt(((a - b) ** 2).sum()))
        n = np.sqrt(a @ a) * np.sqrt(b @ b)
        return float(a @ b / n) if n else 0.0

    for metric, within in (("cosine", None), ("cosine", "g"), ("dot", None), ("l2", None)):
        some = [r for r in rows if metric == "cosine" or (r[1] and len(r[1]) == 6)]
        got = R.dense_top_k(q if within else q.drop("g"), v.where(F.col("item_id").isin([r[0] for r in some])), 6, metric, within).collect()
        for i in range(0, 90, 7):
            want = sorted((-round(plain(metric, x[i], b), 9), j) for j, b, g in some if not within or g == str(i % 3))[:6]
            mine = sorted((r["rank"], r.item_id) for r in got if r.query_id == i)
            assert [j for _, j in mine] == [j for _, j in want], (metric, within, i)


def test_vectors_of_several_lengths(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i % 3).round(3).tolist(), "a" if i % 4 else None) for i in range(60)]
    v = spark.createDataFrame([*rows, (100, None, "a"), (101, [], "a")], "item_id long, vector array<double>, g string")
    q = v.select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"), "g")
    for within in (None, "g"):
        for parts in (1, 7):  # blocks and partitions change nothing
            got = {}
            for r in R.dense_top_k(q, v.drop("g") if within is None else v, 4, within=within, metric="cosine").repartition(parts).collect():
                got.setdefault(r.query_id, []).append((r["rank"], r.item_id, round(r.score, 9)))
            asked = [r for r in rows if within is None or r[2]]
            assert set(got) == {r[0] for r in asked}
            for i, a, _ in asked:
                same = [(j, b) for j, b, _ in asked if len(b) == len(a)]
                best = sorted((-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9), j) for j, b in same)[:4]
                assert [(j, -s) for s, j in best] == [x[1:] for x in sorted(got[i])]


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 6 * 10)
    v = spark.range(50).selectExpr("id item_id", "transform(sequence(1, 6), i -> cast(hash(id, i) % 97 as double)) vector")
    q = v.selectExpr("item_id query_id", "vector query_vector").where("query_id % 3 = 0")
    small = R.dense_top_k(q, v, 3).orderBy("query_id", "rank").collect()
    monkeypatch.undo()
    assert small == R.dense_top_k(q, v, 3).orderBy("query_id", "rank").collect()


def test_passages_and_values_are_found_as_by_trying_all(spark):
    texts = [(1, "xone two three fourx"), (2, "one two three four"), (3, "ONE TWO THREE FOUR"), (4, "a b"), (5, "ab"), (6, None), (7, "")]
    passages = [(1, "one two three four"), (2, "two three"), (3, "b"), (4, "one, two"), (5, None), (6, "three four")]
    got = N.containing(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(passages, "passage_id int, passage string")).collect()
    assert {tuple(r) for r in got} == {(t, p) for t, x in texts for p, y in passages if x is not None and y is not None and y in x}
    asked = [(1, "Report on Oman and Romania"), (2, "nothing"), (3, None), (4, "U S")]
    values = ["oman", "ROMANIA", "us", "u", "o", None, " "]
    rows = N.mentioned_values(spark.createDataFrame(asked, "query_id int, question string"), spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert {r.query_id: r.mentioned for r in rows} == {i: sorted(v.lower() for v in values if v and v.strip() and a and v.lower() in a.lower()) for i, a in asked}


def test_ranks_without_groups(spark):
    rows = [(i, float(i % 37) if i % 5 else None, i % 3 > 0) for i in range(800)]
    got = competition_rank(spark.createDataFrame(rows, "i int, s double, ok boolean"), "s", eligible=F.col("ok")).collect()
    scores = [s for _, s, ok in rows if ok and s is not None]
    assert len(got) == len(rows)
    for r in got:
        want = 1 + sum(x > r.s for x in scores) if r.ok and r.s is not None else None
        assert r["rank"] == want


def test_combinations_and_settings():
    config.check_combination("hybrid_rrf", "faiss", False)
    for bad in (("elasticsearch_dense", "faiss", True), ("dense", "elasticsearch", True), ("category_aware_dense", "faiss", False), ("hybrid_rrf", "faiss", False, "pgvector"), ("x", "faiss", True), ("dense", "x", True)):
        with pytest.raises(ValueError):
            config.check_combination(*bad)
    assert config.differences({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3}, "d": 0}) == {"a.c": (2, 3), "d": (None, 0)}
    assert config.resume_conflicts({"a": {"b": 1}}, {"a": {"b": 2}, "c": 1}, ("a.b", "c", "d")) == ["a.b", "c"]
    assert [config.primary_k([1, 3, 5]), config.primary_k([1, 3]), config.primary_k([1, 3, 5], {"hit": 1}, "hit")] == [5, 3, 1]
    with pytest.raises(ValueError, match="repeated"):
        config.duplicates_in(["a", "b", "a"], "experiments")


def test_report_files(spark, tmp_path):
    records = spark.createDataFrame([("e1", 2, 0.5, None), ("e2", 1, 0.75, "x|y"), ("e3", None, None, None)], "experiment_id string, rank int, score double, note string")
    S.write_report(records, str(tmp_path / "out"), {"board": ("rank", ["experiment_id", "rank", "score", "note"])}, "Runs")
    text = next((tmp_path / "out/comparison.md").glob("part-*.txt")).read_text()
    assert text.index("| e2 | 1 | 0.750000 | x\\|y |") < text.index("| e1 | 2 | 0.500000 |  |") < text.index("| e3 |  |  |  |")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/board.csv")).count() == 3
    assert "The first 1 rows" in S.markdown_table(records, 1)


def test_summaries_and_manifests(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1/summary.json").write_text(json.dumps({"summary_by_experiment": [{"experiment_id": "e", "mean_recall": 0.5}]}))
    rows = S.read_summaries(spark, [str(tmp_path / "r1/summary.json")], ("mean_recall",)).collect()
    assert [(r.experiment_id, r.mean_recall) for r in rows] == [("e", 0.5)]
    for bad in ([{"experiment_id": "e", "mean_recall": 1.5}], [{"experiment_id": "e", "mean_recall": 0.5}] * 2):
        (tmp_path / "r1/bad.json").write_text(json.dumps({"summary_by_experiment": bad}))
        with pytest.raises(Exception, match="out of bounds|not exactly one"):
            S.read_summaries(spark, [str(tmp_path / "r1/bad.json")], ("mean_recall",)).collect()
    with pytest.raises(FileNotFoundError):
        S.read_manifest(spark, str(tmp_path / "r1"))
    (tmp_path / "r1/manifest.json").write_text('{"run_id": 1}')
    assert S.read_manifest(spark, str(tmp_path / "r1")) == {"run_id": 1}
    body = (tmp_path / "r1/manifest.json").read_bytes()
    assert S.file_hashes(spark, str(tmp_path / "r1/manifest.json")).first().sha256 == hashlib.sha256(body).hexdigest()
    assert S.canonical_hash({"b": 1, "a": 2}) == S.canonical_hash({"a": 2, "b": 1}) != S.canonical_hash({"a": 2})
    semantic = spark.createDataFrame([("p3_e1", 10, 2, 0.5)], "run_id string, n long, nan_f long, mean_f double")
    one = S.semantic_summaries(semantic, ("f", "g")).first()
    assert (one.experiment_id, one.nan_rate_f, one.missing_metrics) == ("e1", 0.2, 1)
    assert S.preflight({"top_k": 5, "fetch_k": 3}, {"q": semantic}, {"q": ("run_id", "zz"), "g": ()}) == ["q lacks the field zz", "g is missing", "fetch_k must not be less than top_k"]
    assert S.granularity({}, True, True)["primary"] == "chunk"
    with pytest.raises(ValueError):
        S.granularity({"granularity": "chunk"}, True, False)


def test_table_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    K.write_buckets(spark.range(100).select("id", F.lit("old").alias("v")), at, "id", 8)
    files = set(K.read_buckets(spark, at).inputFiles())
    got = K.upsert(at, spark.createDataFrame([(5, "new"), (500, "new")], "id long, v string"), "id")
    assert got.count() == 101
    assert sorted(r.id for r in got.where("v = 'new'").collect()) == [5, 500]
    assert len(files & set(got.inputFiles())) >= len(files) - 2  # folders that no row fell in are left alone
    K.publish(spark, str(tmp_path / "alias"), at)
    assert K.published(spark, str(tmp_path / "alias")).count() == 101
    K.append_events(spark.createDataFrame([("start", 1)], "event string, n int"), str(tmp_path / "log"), "r1")
    K.append_events(spark.createDataFrame([("end", 2)], "event string, n int"), str(tmp_path / "log"), "r1")
    log = spark.read.json(str(tmp_path / "log")).collect()
    assert {(r.event, json.loads(r.payload)["n"]) for r in log} == {("start", 1), ("end", 2)}


def test_model_hooks(spark):
    metric = X.SemanticMetric("faith", lambda rows: [float("nan") if a == "?" else 0.5 for a in rows["answer"]])
    rows = spark.createDataFrame([("1", "q", "a"), ("2", "q", "?")], "question_id string, question string, answer string")
    assert sorted(tuple(r) for r in metric.apply(rows).collect()) == [("1", 0.5, "ok"), ("2", None, "nan")]
    broken = X.SemanticMetric("bad", lambda rows: 1 / 0)
    assert {r.bad_status for r in broken.apply(rows).collect()} == {"failed: ZeroDivisionError"}
    text = "  ab cd ef"
    ranges = list(token_char_ranges(text, 4, 1, lambda t: [(i, i + 1) for i in range(len(t))]))
    assert all(text[a:b] == t for a, b, t, _, _ in ranges)
    assert X.SemanticMetric.registry["faith"] is metric


def test_run_checks_on_bad_rows(spark):
    empty = spark.createDataFrame([], "experiment_id string, question_id string, generated_answer string, retrieved_chunk_ids array<string>, latency_ms double")
    suspicious = {r.check for r in U.fake_run_checks(empty, 5, evaluated=3).collect() if r.suspicious}
    assert suspicious == {"zero_rows", "metrics_without_rows"}
    rows = spark.createDataFrame([("e", "q1", "same", ["c"], 1.0)] * 5 + [("e", "q2", "other", [], None)], empty.schema)
    assert {r.check for r in U.fake_run_checks(rows, 6).collect() if r.suspicious} == {"repeated_questions", "many_answers_identical"}
    with pytest.raises(Exception, match="blank chunk identifiers"):
        bad = spark.createDataFrame([("q", ["a", " "])], "question_id string, retrieved_chunk_ids array<string>")
        bad.select(U.retrieved_chunk_ids(bad).alias("x")).collect()
    with pytest.raises(TypeError):
        U.retrieved_chunk_ids(spark.createDataFrame([("q", [1])], "question_id string, retrieved_chunk_ids array<int>"))
    run = spark.createDataFrame([("q1", 1), ("q2", 2)], "question_id string, v int")
    with pytest.raises(Exception, match="belongs to no row"):
        U.repaired(run, spark.createDataFrame([("q9", 1)], run.schema)).collect()
    assert sorted(tuple(r) for r in U.repaired(run, spark.createDataFrame([("q2", 9)], run.schema)).collect()) == [("q1", 1), ("q2", 9)]
    told = spark.range(1).select(U.chunk_config(F.lit("E91_fixed512_overlap64")).alias("c")).first().c
    assert tuple(told) == ("fixed_token", 512, 64)
