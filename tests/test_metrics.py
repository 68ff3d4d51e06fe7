"""Hand-computed cases of the ranking and answer metrics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T


def ranked(spark, retrieved, gold, k, f=M.rank_metrics):
    df = spark.createDataFrame([(retrieved, gold)], "retrieved array<string>, gold array<string>")
    return df.select(*[c.alias(n) for n, c in f(F.col("retrieved"), F.col("gold"), k).items()]).first().asDict()


@pytest.mark.parametrize(
    ("retrieved", "gold", "k", "expected"),
    [
        (["A", "B", "C"], ["A"], 3, {"hit": 1, "recall": 1, "mrr": 1, "precision": 1 / 3, "ndcg": 1}),
        (["X", "A", "B"], ["A", "B"], 3, {"mrr": 0.5, "precision": 2 / 3, "ndcg": (1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3))}),
        (["a", "a", "b"], ["a", "b"], 3, {"precision": 2 / 3, "duplicates": 1, "duplicate_rate": 1 / 3}),
        (["A", "A", "A", "G"], ["G"], 3, {"hit": 0}),
        (["A", "A", "A", "G"], ["G"], 4, {"hit": 1, "mrr": 0.25}),
        (["A", "B"], [], 5, {"recall": None, "hit": 0, "ndcg": 0, "mrr": 0}),
        ([], ["A"], 5, {"recall": 0, "precision": 0, "duplicate_rate": 0}),
        (None, None, 5, {"recall": None, "hit": 0}),
    ],
)
def test_rank_metrics(spark, retrieved, gold, k, expected):
    got = ranked(spark, retrieved, gold, k)
    for name, value in expected.items():
        assert got[name] == (pytest.approx(value) if value is not None else None), name


def test_distinct_rank_metrics(spark):
    got = ranked(spark, ["A", "A", "A", "G"], ["G"], 3, M.distinct_rank_metrics)
    assert (got["hit"], got["mrr"]) == (1, 0.5)
    assert ranked(spark, ["", None, "G"], ["G"], 3, M.chunk_metrics)["mrr"] == 1
    assert ranked(spark, ["A"], [], 3, M.chunk_metrics)["recall"] == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("  Größe_x  STRASSE 12 ", "unknown.", "What is the price of steel", "The price is 5")], "a string, b string, q string, r string")
    row = df.select(
        T.search_tokens(F.col("a")).alias("tokens"), T.normalize_text(F.lit("Maß  STRASSE ")).alias("norm"), T.is_abstention(F.col("b")).alias("abstains"), T.lexical_f1(F.col("q"), F.col("r")).alias("f1"),
        T.safe_int(F.lit("+12")).alias("i"), T.safe_int(F.lit("1.5")).alias("j"), T.source_id(F.lit(r"C:\x\Doc.TXT_chunk_3")).alias("src"), T.first_truthy(F.lit(""), F.lit("x")).alias("first"),
    ).first()
    assert row.tokens == ["größe", "x", "strasse", "12"]
    assert (row.norm, row.abstains, row.i, row.j, row.src, row["first"]) == ("mass strasse", True, 12, None, "doc.txt", "x")
    assert row.f1 == pytest.approx(2 * 1 / (2 + 2))


def test_scores(spark):
    one = spark.range(1)
    got = one.select(
        M.retrieval_score(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("r"), M.judge_overall(*[F.lit(float(x)) for x in (5, 5, 5, 0, 5)]).alias("j"),
        M.category_accuracy(F.lit("A"), F.lit("a ")).alias("c"), M.category_accuracy(F.lit(None).cast("string"), F.lit("a")).alias("n"), M.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("z"),
    ).first()
    assert got.r == pytest.approx(0.75)
    assert (got.j, got.c, got.n, got.z) == (5.0, 1.0, None, 0.0)
