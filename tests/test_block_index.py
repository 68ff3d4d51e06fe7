"""Skipping search gives what scoring every posting gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators.block_index import BlockIndex

SF = "/root/testdata/sf0.01"


def hits(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    short = docs.where("doc_id % 20 = 0").select((F.col("doc_id") + 100_000).alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 3, 4), " ").alias("question"))
    return docs, queries.unionByName(short)


def test_results_are_those_of_all_postings(spark, corpus, tmp_path):
    docs, queries = corpus
    index = R.TextIndex.build(docs, "doc_id", "text", only=R.query_terms(queries))
    BlockIndex.build(index, str(tmp_path / "blocks"), size=16)
    made = BlockIndex.load(spark, str(tmp_path / "blocks"))
    found, report = made.search(queries, 10)
    assert hits(found) == hits(R.bm25_top_k(queries, index, 10))
    row = report.agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored"), F.count_if(F.expr("scored > blocks")).alias("odd")).first()
    assert row["odd"] == 0 and row["scored"] < 0.8 * row["blocks"]
    among = queries.select("query_id").join(docs.select(F.col("doc_id").alias("item_id"), "source"), F.expr("source = concat('src', query_id % 20)")).select("query_id", "item_id")
    found, _ = made.search(queries, 10, among=among)
    assert hits(found) == hits(R.bm25_top_k(queries, index, 10, among=among))


def test_other_parameters_and_odd_texts(spark):
    texts = [(1, "a b c"), (2, "a a b"), (3, ""), (4, None), (5, "c " * 500), (6, "a"), (7, "a b c")] + [(10 + i, "a b " + "z " * i) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "c a"), (3, ""), (4, None), (5, "nowhere"), (6, "a a b z"), (7, "C")], "query_id long, question string")
    index = R.TextIndex.build(docs, "doc_id", "text")
    for k1, b, size, k in ((0.5, 0.1, 1, 3), (1.5, 0.75, 4, 1), (2.0, 0.0, 1000, 100)):
        found, _ = BlockIndex.build(index, k1=k1, b=b, size=size).search(queries, k)
        assert hits(found) == hits(R.bm25_top_k(queries, index, k, k1=k1, b=b))
    empty = R.TextIndex.build(docs.where("false"), "doc_id", "text")
    assert BlockIndex.build(empty).search(queries, 3)[0].collect() == []


def test_pairs_of_queries_and_items_do_not_move(spark, corpus):
    """Scores are added up where an item's postings are: no exchange deals pairs out."""
    import re

    docs, queries = corpus
    index = R.TextIndex.build(docs, "doc_id", "text", only=R.query_terms(queries))
    among = queries.select("query_id").join(docs.select(F.col("doc_id").alias("item_id"), "source"), F.expr("source = concat('src', query_id % 20)")).select("query_id", "item_id")
    for found in (R.bm25_scores(queries, index), R.bm25_scores(queries, index, among=among), BlockIndex.build(index).search(queries, 10)[0]):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, (block#\d+L?, )?item_id", plan)
