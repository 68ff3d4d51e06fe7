"""Differences of tables of documents against the recursion over each pair."""

from __future__ import annotations

import json
import random

from lodestone.config import differences
from lodestone.operators.nested import nested_differences


def plain(a, b):
    none = lambda v: None if v is None else json.dumps(v, sort_keys=True, separators=(",", ":"))
    if isinstance(a, dict) and isinstance(b, dict):
        return sorted((p, none(x), none(y)) for p, (x, y) in differences(a, b).items())
    return [] if a == b else [("", none(a), none(b))]


def test_documents_by_the_recursion(spark):
    draw = random.Random(2)

    def value(depth):
        kind = draw.random()
        if depth and kind < 0.6:
            return {draw.choice("abcd"): value(depth - 1) for _ in range(draw.randrange(0, 4))}
        return draw.choice([None, 1, 2.5, "x", True, [1, 2], [{"a": 1}], [], "1"])

    pairs = {i: (value(4), value(4)) for i in range(120)}
    pairs |= {i: (a := value(5), a) for i in range(200, 220)}
    pairs |= {300: ({"a": {"b": 1}}, {"a": {"b": 1, "c": None}}), 301: ({"key": {"pos": 1}}, {"key": {"pos": 2}})}
    frame = lambda side: spark.createDataFrame([(i, json.dumps(p[side])) for i, p in pairs.items()], "id long, doc string")
    got = {i: [] for i in pairs}
    for r in nested_differences(frame(0), frame(1), "id", "doc").collect():
        got[r.id].append((r.path, r.left, r.right))
    assert {i: sorted(x) for i, x in got.items()} == {i: plain(a, b) for i, (a, b) in pairs.items()}


def test_missing_documents(spark):
    left = spark.createDataFrame([(1, '{"a":1}'), (2, None), (None, '{"a":1}')], "id long, doc string")
    right = spark.createDataFrame([(3, '{"b":2}'), (2, '"x"')], "id long, doc string")
    got = sorted((r.id or 0, r.path, r.left, r.right) for r in nested_differences(left, right, "id", "doc").collect())
    assert got == [(0, "", '{"a":1}', None), (1, "", '{"a":1}', None), (2, "", None, '"x"'), (3, "", None, '{"b":2}')]
