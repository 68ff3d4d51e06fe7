"""Whitening against a plain eigendecomposition of the whole matrix."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from lodestone.llm.queries import QUERIES
from lodestone.llm.whitening import embedding_whitening, fit_whitening, subspace_iteration

ROWS = "vec_id long, embedding array<float>, n int, component string, x int"


def frame(spark, rows):
    """With further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], ROWS)


def plain(rows, k=4, scale=256):
    """Rows of ``(vec_id, component, n, deviation, |whitened|, explained)`` by the definition; components are told up to their sign."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = [c for c in range(min(k, dim)) if values[c] > 1e-9 * values[0]]
    out = []
    for i, x in kept:
        y = (np.array(x) - np.array(sums) / n) @ vectors[:, some] / np.sqrt(values[some])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out += [(i, c + 1, n, deviation, y[c], values[c] / values.sum()) for c in some]
    return out


def agree(got, expected, close=1e-8):
    assert len(got) == len(expected)
    got = sorted(got, key=lambda r: (r.vec_id is None, r.vec_id, r.component, r.deviation, abs(r.whitened)))
    expected = sorted(expected, key=lambda r: (r[0] is None, r[0], r[1], r[3], abs(r[4])))
    signs = {}
    for r, (i, c, n, deviation, y, explained) in zip(got, expected, strict=True):
        assert (r.vec_id, r.component, r.n, r.deviation) == (i, c, n, deviation)
        assert math.isclose(abs(r.whitened), abs(y), rel_tol=close, abs_tol=close)
        assert math.isclose(r.explained, explained, rel_tol=1e-9)
        assert 0 <= r.identity_error <= 1e-9
        if abs(y) > 1e-6:
            assert signs.setdefault(c, math.copysign(1, r.whitened * y)) == math.copysign(1, r.whitened * y)  # one sign for all rows


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    agree(QUERIES["op13_embedding_whitening"](spark, sf).collect(), plain(rows))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 0.0, 0.0, 0.0]), (42, [math.nan] * 5), (43, [math.inf, 0, 0, 0, 0]), (44, [-0.0] * 5), (None, [0.25] * 5)]
    rows += [(7, rows[7][1])] * 30  # repeats weigh nothing
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    agree(embedding_whitening(frame(spark, rows).repartition(5)).collect(), plain(rows))


def test_few_directions_and_ties(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]  # one direction varies
    got = embedding_whitening(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9
    agree(got, plain(rows))
    square = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])]  # equal eigenvalues: any basis
    got = embedding_whitening(frame(spark, square)).collect()
    assert len(got) == 8 and all(math.isclose(r.explained, 0.5) and r.identity_error < 1e-12 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_varies(spark, rows):
    assert embedding_whitening(frame(spark, rows)).collect() == []


def test_lengths_and_large_entries(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 5.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    got = embedding_whitening(frame(spark, rows)).collect()
    assert {r.vec_id: r.deviation is None for r in got} == {1: False, 2: False, 3: False, 4: True, 5: True}
    agree([r for r in got if r.vec_id < 4], plain(rows[:3]))
    large = [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])]  # saturates; what doesn't fit is null
    got = embedding_whitening(frame(spark, large)).collect()
    assert {r.n for r in got} == {3} and all(r.deviation is None for r in got)
    model = fit_whitening(frame(spark, large))
    assert model.sums[0] == (1 << 63) - 1


@pytest.mark.parametrize("dim,block", [(60, 16), (200, 16), (30, 30)])
def test_residuals_certify(dim, block):
    draw = np.random.default_rng(dim)
    turn = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    values = np.linspace(1.2, 0.9, dim)
    matrix = (turn * values) @ turn.T
    found, vectors, residuals, _ = subspace_iteration(lambda q: matrix @ q, dim, 4, block)
    assert np.allclose(found, values[:4], rtol=1e-12)
    assert np.allclose(np.abs((turn[:, :4] * vectors).sum(0)), 1, atol=1e-10)
    assert residuals.max() < 1e-9
