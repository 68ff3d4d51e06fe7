"""Many patterns at once against looking for each of them."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators.patterns import HEAD, Matcher, find_patterns, forbidden_terms


def plain(text, patterns):
    out = {}
    for p in patterns:
        at = [i for i in range(len(text)) if p and text.startswith(p, i)]
        if at:
            out[p] = (len(at), at[0])
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=40), st.lists(st.text("abé", max_size=5), max_size=12))
def test_matcher_finds_what_is_there(text, patterns):
    assert Matcher(patterns).find(text) == plain(text, set(patterns))


def test_long_patterns_share_their_beginning():
    base = "x" * (HEAD + 5)
    patterns = [base, base + "a", base + "b", base[:-1], base + "a" * 100]
    text = base + "a" + base + "b"
    assert Matcher(patterns).find(text) == plain(text, patterns)


def test_spark_in_parts(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randrange(1, 5)))
    texts = [(i, " ".join(word() for _ in range(30))) for i in range(40)] + [(100, None), (101, ""), (0, "abc abc")]
    patterns = [(k, word()) for k in range(60)] + [(200, None), (201, ""), (5, "abc")]
    t, p = spark.createDataFrame(texts, "text_id long, text string").repartition(3), spark.createDataFrame(patterns, "pattern_id int, pattern string")
    want = sorted((i, k, *found) for i, text in texts if text for k, x in patterns if x and (found := plain(text, [x]).get(x)))
    for most in (None, 10, 1):
        assert sorted(map(tuple, find_patterns(t, p, most).collect())) == want
    assert find_patterns(t, p.where("false")).collect() == [] and find_patterns(t.where("false"), p).collect() == []


def test_a_hundred_thousand_patterns(spark):
    patterns = spark.range(100_000).select(F.col("id").alias("pattern_id"), F.concat(F.lit("common beginning of "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pattern"))
    texts = spark.range(2000).select(F.col("id").alias("text_id"), F.concat(F.lit("x common beginning of "), F.lpad((F.col("id") * 50).cast("string"), 6, "0"), F.lit(" and common beginning")).alias("text"))
    got = find_patterns(texts, patterns)
    row = got.agg(F.count("*").alias("n"), F.count_if((F.col("pattern_id") == F.col("text_id") * 50) & (F.col("first") == 2)).alias("right")).first()
    assert (row["n"], row["right"]) == (2000, 2000)


def test_forbidden_terms(spark):
    texts = spark.createDataFrame([("a", "The Gold_Answer is GOLD_ANSWER"), ("b", "nothing"), ("c", None)], "text_id string, text string")
    assert [tuple(r) for r in forbidden_terms(texts, ["gold_answer", "secret"]).collect()] == [("a", "gold_answer", 2)]
