"""The inverted file and the neighbour graph against exact search: equal when asked for all, measured otherwise."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vector_index as V
from lodestone.operators.retrieval import dense_top_k

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category")).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"), "category").cache()


@pytest.fixture(scope="module")
def ivf(vectors, tmp_path_factory):
    return V.InvertedFile.build(vectors, str(tmp_path_factory.mktemp("ivf") / "index"))


@pytest.fixture(scope="module")
def graph(vectors, tmp_path_factory):
    return V.NeighbourGraph.build(vectors, str(tmp_path_factory.mktemp("graph") / "index"), bucket=64)


def hits(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())


def recall(found, exact, k=10):
    return V.recall_at(found, exact, k).agg(F.avg("recall")).first()[0]


def test_all_lists_are_exact(spark, vectors, queries, ivf):
    again = V.InvertedFile.load(spark, ivf.path)
    assert again.items.count() == vectors.count()
    exact = dense_top_k(queries.drop("category"), vectors, 10)
    assert hits(again.search(queries, 10, nprobe=len(ivf.centres))) == hits(exact)
    own = dense_top_k(queries, vectors, 5, within="category")
    assert hits(again.search(queries, 5, nprobe=len(ivf.centres), within="category")) == hits(own)


def test_default_lists_find_most(vectors, queries, ivf):
    found = ivf.search(queries, 10)
    assert ivf.nprobe < len(ivf.centres)
    assert recall(found, dense_top_k(queries, vectors, 10)) >= 0.9


def test_lists_are_pruned(ivf, queries):
    read = ivf.items.where(F.col("list").isin([1, 2])).select("item_id")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1].split("]")[0]
    few = queries.where("query_id = 0")
    assert hits(ivf.search(few, 1, nprobe=1))[0][2] == 0  # it finds itself in the first list


def test_filters_leave_nothing_out(vectors, queries, ivf, graph):
    rare = F.col("item_id") % 97 == 5
    exact = hits(dense_top_k(queries, vectors.where(rare), 5))
    assert hits(ivf.search(queries, 5, nprobe=1, where=rare)) == exact
    assert len(hits(graph.search(queries, 20, candidates=20, where=F.col("item_id") % 251 == 5))) == queries.count() * 2  # two pass
    some = F.col("category") == "3"
    found = graph.search(queries, 10, where=some)
    assert {r.category for r in found.collect()} == {"3"}
    assert recall(found, dense_top_k(queries, vectors.where(some), 10)) >= 0.9


def test_walks_find_most(spark, vectors, queries, graph):
    again = V.NeighbourGraph.load(spark, graph.path)
    assert recall(again.search(queries, 10), dense_top_k(queries, vectors, 10)) >= 0.9


def test_clusters_need_few_lists(spark, tmp_path):
    draw = np.random.default_rng(1)
    middles = draw.normal(size=(30, 8)) * 10
    x = np.concatenate([m + draw.normal(size=(40, 8)) for m in middles])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, vector array<double>")
    for metric in ("l2", "cosine", "dot"):
        made = V.InvertedFile.build(v, str(tmp_path / metric), metric=metric, lists=30)
        q = v.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"))
        if metric != "dot":
            assert made.nprobe <= 6
        assert recall(made.search(q, 10), dense_top_k(q, v, 10, metric)) >= 0.9


@pytest.mark.parametrize("metric", V.METRICS)
def test_a_round_gives_the_best_of_all_pairs_around_a_vector(spark, metric):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(40, 4)).round(1)
    around = [(a, int(b), bool(draw.random() < 0.5), x[b].tolist(), float("-inf") if b % 3 else (-0.5 if metric == "l2" else 0.5)) for a in range(9) for b in draw.choice(40, 12, replace=False)]
    rows = spark.createDataFrame(around, "a long, b long, new boolean, vector array<double>, least double")
    many = spark.sparkContext.defaultParallelism
    got = V._met(rows.repartition(many, "a").sortWithinPartitions("a"), 3, metric).collect()
    want = {}
    for a in range(9):
        mine = [r for r in around if r[0] == a]
        for _, p, new_p, vp, least in mine:
            u = np.array(vp)
            found = []
            for _, q, new_q, vq, _ in mine:
                v = np.array(vq)
                score = {"l2": -np.sqrt(((u - v) ** 2).sum()), "dot": (u * v).sum(), "cosine": (u * v).sum() / (np.linalg.norm(u) * np.linalg.norm(v))}[metric]
                if p != q and (new_p or new_q) and round(score, 9) >= least:
                    found.append((-round(score, 9), q))
            for score, q in sorted(found)[:3]:
                want[p, q] = -score
    assert {(r.a, r.b): pytest.approx(r.score, abs=1e-8) for r in got} == want


def test_vectors_move_once_to_what_they_are_near_to(spark, tmp_path, monkeypatch):
    moved = []
    monkeypatch.setattr(V, "_pair_scores", lambda *a: moved.append(a))
    x = np.random.default_rng(5).normal(size=(300, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, vector array<double>")
    V.NeighbourGraph.build(v, str(tmp_path / "graph"), bucket=64, rounds=2)
    assert not moved  # no pairs with both of their vectors


@pytest.mark.parametrize("kind", [V.InvertedFile, V.NeighbourGraph])
def test_odd_vectors(spark, tmp_path, kind):
    schema = "item_id long, vector array<double>, note string"
    empty = kind.build(spark.createDataFrame([], schema), str(tmp_path / "empty"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0])], "query_id long, query_vector array<double>")
    assert empty.search(q, 3).collect() == []
    odd = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 0.0], None), (4, None, "d"), (5, [], "e"), (6, [0.0, 1.0], "f")], schema)
    found = kind.build(odd, str(tmp_path / "odd")).search(q, 9)
    assert hits(found) == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 0.0), (1, 4, 6, 0.0)]
    assert found.columns == ["item_id", "query_id", "score", "rank", "note"]
    with pytest.raises(ValueError, match="one length"):
        kind.build(odd.unionByName(spark.createDataFrame([(9, [1.0], "x")], schema)), str(tmp_path / "mixed"))
    with pytest.raises(ValueError, match="metric"):
        kind.build(odd, str(tmp_path / "m"), metric="jaccard")
