"""The range join and what is built on it, against trying all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals as I

LEFT, RIGHT = "d string, i int, a long, b long", "d string, j int, x long, y long"


def joined(left, right):
    return I.interval_join(left, right, "d", ("a", "b"), ("x", "y"))


def test_join_is_that_of_all_pairs(spark):
    draw = random.Random(3)
    rows = lambda n: [(draw.choice("pqr"), k, s := draw.randrange(-50, 3000), s + int(2 ** draw.uniform(-1, 11))) for k in range(n)]
    one = [*rows(150), ("p", 900, None, 5), ("p", 901, 5, 5), ("p", 902, 9, 3), (None, 903, 0, 9), ("p", 904, 0, 1 << 40)]
    two = [*rows(150), ("p", 900, 3, None), (None, 901, 0, 9), ("q", 902, -(1 << 35), 1 << 35), ("p", 903, 7, 8), ("p", 903, 7, 8)]
    got = sorted((r.i, r.j) for r in joined(spark.createDataFrame(one, LEFT), spark.createDataFrame(two, RIGHT)).collect())
    want = sorted((i, j) for d, i, a, b in one for e, j, x, y in two if None not in (d, e, a, b, x, y) and d == e and a < b and x < y and a < y and x < b)
    assert got == want


def test_empty_sides(spark):
    some, none = spark.createDataFrame([("p", 1, 0, 9)], LEFT), spark.createDataFrame([], RIGHT)
    assert joined(some, none).collect() == []
    assert joined(some.where("false"), spark.createDataFrame([("p", 1, 0, 9)], RIGHT)).collect() == []


def test_one_long_document(spark):
    """100,000 spans and as many chunks of one document: many keys, and no more rows than meet."""
    spans = spark.range(100_000).selectExpr("id span_id", "1L doc_id", "id * 100 + 50 s_start", "id * 100 + 130 s_end")
    chunks = spark.range(100_000).selectExpr("id item_id", "1L doc_id", "id * 100 start", "id * 100 + 100 end")
    got = I.span_overlaps(spans, chunks, "report")
    row = got.agg(F.count("*").alias("n"), F.count_if("is_primary").alias("first"), F.sum("overlap").alias("overlap")).first()
    assert (row["n"], row["first"], row["overlap"]) == (2 * 100_000 - 1, 100_000, 100_000 * 80 - 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_mapping(chunks, sections):
    out = {}
    for d, i, a, b in chunks:
        mine = [s for s in sections if s[0] == d]
        at = [s for s in mine if s[2] is not None]
        if not mine:
            out[d, i] = (None, "no_sections", [])
        elif len(mine) == 1:
            out[d, i] = (mine[0][1], "document_level_fallback" if mine[0][4] == 0 else "sole_section", [])
        elif a is None:
            out[d, i] = (None, "text_not_found", [])
        else:
            inside = sorted((s for s in at if s[2] <= a and s[3] >= b), key=lambda s: (-s[4], s[3] - s[2], s[5]))
            over = [s for s in at if s not in inside and min(b, s[3]) > max(a, s[2])]
            over.sort(key=lambda s: (max(a, s[2]) - min(b, s[3]), -s[4], s[5]))
            if inside:
                out[d, i] = (inside[0][1], "document_level_fallback" if inside[0][4] == 0 else "fully_contained", [s[1] for s in inside[1:]])
            elif over:
                out[d, i] = (over[0][1], "boundary_spanning" if len(over) > 1 else "overlap_based", [s[1] for s in over[1:]])
            else:
                out[d, i] = (min(at, key=lambda s: (s[2], s[5]))[1], "no_overlap_fallback", []) if at else (None, "no_overlap", [])
    return out


def test_all_nine_mappings(spark):
    draw = random.Random(5)
    sections = [("deep", f"s{k}", *sorted(draw.sample(range(0, 400), 2)), draw.randrange(0, 5), k) for k in range(25)]
    sections += [("sole", "only", 0, 10, 2, 0), ("whole", "doc", 0, 10, 0, 0), ("lost", "x", None, None, 1, 0), ("lost", "y", None, None, 1, 1), ("far", "f1", 50, 60, 1, 1), ("far", "f0", 50, 70, 1, 0), ("part", "p0", 0, 10, 1, 0), ("part", "p1", 20, 30, 1, 1)]
    chunks = [("deep", k, *sorted(draw.sample(range(-20, 420), 2))) for k in range(80)] + [("deep", 99, None, None)]
    chunks += [(d, 1, 5, 15) for d in ("sole", "whole", "lost", "far", "part", "none")] + [("part", 2, 5, 25), ("sole", 2, None, None), ("lost", 2, None, None)]
    made = I.map_to_sections(spark.createDataFrame(chunks, "doc_id string, item_id int, start long, end long"), spark.createDataFrame(sections, "doc_id string, parent_id string, s_start long, s_end long, level int, ordinal int"), candidates=True)
    got = {(r.doc_id, r.item_id): (r.parent_id, r.mapping, r.candidates) for r in made.collect()}
    want = plain_mapping(chunks, sections)
    assert got == want
    assert {m for _, m, _ in want.values()} == {I.NO_SECTIONS, I.SOLE, I.DOCUMENT, I.CONTAINED, I.SPANNING, I.OVERLAP, I.NONE, I.NONE_FALLBACK, I.NOT_FOUND}
    assert all(r.boundary_spanning == (r.mapping == I.SPANNING) for r in made.collect())


def test_spans_without_a_chunk(spark):
    spans = spark.createDataFrame([(1, 7, 0, 5), (2, 7, 90, 95), (3, 8, 0, 5), (4, 7, None, 3)], "span_id int, doc_id int, s_start long, s_end long")
    chunks = spark.createDataFrame([(7, "a", 0, 3), (7, "b", 3, 9)], "doc_id int, item_id string, start long, end long")
    with pytest.raises(Exception, match="touches no chunk"):
        I.span_overlaps(spans, chunks).collect()
    got = I.span_overlaps(spans, chunks, "report").collect()
    assert sorted((r.span_id, r.item_id, r.overlap, r.is_primary, r.mapping_status) for r in got if r.item_id) == [(1, "a", 3, True, "mapped"), (1, "b", 2, False, "mapped")]
    assert sorted(r.span_id for r in got if r.mapping_status == "unmapped") == [2, 3, 4]
    assert I.span_overlaps(spans, chunks, "drop").count() == 2
    assert I.span_overlaps(spans.where("span_id = 1"), chunks).count() == 2
    with pytest.raises(ValueError):
        I.span_overlaps(spans, chunks, "ignore")
