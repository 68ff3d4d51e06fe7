"""Line labels: counts by their definitions, decoding and fit by enumeration, decisions on held-out rows."""

from __future__ import annotations

import itertools
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.line_quality import FAMILIES, N_FEATURES, OTHER_SPACE, LineField, _ascend, fit_lines, label_lines, read_lines, repeated_words, viterbi
from lodestone.llm.queries import QUERIES

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def counts(text):
    x = read_lines(text)
    return x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words


ODD = ["", None, " \n\t\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\nx\ny\nx ", "\x1fa\xa0b\x85c d\x0be\x0cf\rg", "日本 語\n日本 語", "# * $ %&|<>", "a\n\n\na", "A b c\n" * 40]


@pytest.mark.parametrize("text", ODD)
def test_counts_of_odd_texts(text):
    assert counts(text) == plain(text)[:5]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab #|\n\t\x1c\xa0é\x0b"), max_size=60))
def test_counts_by_definition(text):
    assert counts(text) == plain(text)[:5]


def test_white_space_that_does_not_separate():
    separators = set(" \t\n\x0b\x0c\r")
    assert {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()} - separators == {chr(c) for c in range(sys.maxunicode + 1) if OTHER_SPACE.match(chr(c))}


def test_repeats_in_a_very_long_text():
    words = [f"w{i}" for i in range(300_000)]
    assert repeated_words([words]) == 0
    assert repeated_words([words, ["x"], words[:10], words[5:8]]) == 23


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_viterbi_is_the_best_sequence(emissions, move):
    move = np.array(move).reshape(2, 2)

    def score(tags):
        return sum(e * t for e, t in zip(emissions, tags, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(tags))

    best = max(score(t) for t in itertools.product((0, 1), repeat=len(emissions)))
    assert abs(score(viterbi(emissions, move)) - best) < 1e-9


def test_fit_climbs_the_likelihood():
    """The ascent must raise the exact likelihood, counted over all sequences of tags."""
    draw = np.random.default_rng(5)
    x = draw.integers(0, 3, (12, 1)) + np.cumsum([0, *FAMILIES.values()])[:-1][None, :]
    y = np.array([0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1], float)
    starts, ends = np.array([0, 4, 8]), np.array([4, 8, 12])

    def likelihood(field):
        total = 0.0
        for a, b in zip(starts, ends, strict=True):
            e = field.weights[x[a:b]].sum(1) + field.bias
            score = lambda t, e=e: float((e * t).sum() + sum(field.move[int(p), int(q)] for p, q in itertools.pairwise(t)))
            total += score(y[a:b]) - np.logaddexp.reduce([score(np.array(t)) for t in itertools.product((0, 1), repeat=b - a)])
        return total

    blank = LineField(np.zeros(N_FEATURES), 0.0, np.zeros((2, 2)))
    assert likelihood(_ascend(x, y, starts, ends, 60, 0.1)) > likelihood(_ascend(x, y, starts, ends, 5, 0.1)) > likelihood(blank)


def test_fit_with_one_class_or_none():
    for rows in ([], [(0, "a b c")], [(1, "a b c")], [(0, ""), (1, None)]):
        assert fit_lines(rows).decode(read_lines("some words\nand more").features) == [0, 0]


def test_field_learns_the_bad_lines():
    prose = "The cat sat on the mat and looked at the other one for a while."
    menu = "Home | Shop | About | Log in"
    field = fit_lines([(0, "\n".join([prose, f"{prose} Again {i}."])) for i in range(40)] + [(1, "\n".join([menu, f"Next | {i} | More", prose])) for i in range(40)])
    assert field.decode(read_lines("\n".join([prose, menu, menu])).features) == [0, 1, 1]


def test_odd_rows_in_spark(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [*ODD, prose, "| " * 60, prose + "\n" + "#### " * 60, "x y " * 400_000 + "\n", prose]
    rows = [(i, t, "other", 3, False) for i, t in enumerate(texts)] + [(None, prose, "other", 3, True), (3, "a", "other", 3, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept boolean").repartition(3)  # clashing names
    weights = np.zeros(N_FEATURES)
    first = list(np.cumsum([0, *FAMILIES.values()])[:-1])[list(FAMILIES).index("marks")]
    weights[first] = -1.0  # no marks: content
    field = LineField(weights, 0.5, np.zeros((2, 2)))
    got = label_lines(docs, field).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        if i != len(texts) - 2:  # too long for the plain version
            assert plain(t) in [tuple(r[c] for c in BASE) for r in by_id[i]]
    kept = by_id[len(ODD)][0]
    assert kept.kept and kept.content_share == 1 and kept.boilerplate == []
    mixed = by_id[len(ODD) + 2][0]
    assert [(s.start, s.end) for s in mixed.boilerplate] == [(len(prose) + 1, len(prose) + 1 + 300)] and mixed.content_share == 0.5 and mixed.kept
    long = by_id[len(ODD) + 3][0]
    assert (long.n_words, long.n_repeat_words, long.base_failed, long.kept) == (800_000, 800_000, True, False)
    assert by_id[None][0].kept and len(by_id[3]) == 2
    assert label_lines(docs.where("false"), field).collect() == []


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op11_line_quality"](spark, sf).collect()}
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = [(got[i], q) for i, q in quality.items() if q is not None and got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    able = [(r.kept, q) for r, q in rows if not r.base_failed]
    assert sum(k for k, q in able if q == 1) >= 0.99 * sum(q == 1 for _, q in able)
    assert sum(not k for k, q in able if q == 0) >= 0.95 * sum(q == 0 for _, q in able)
    assert not any(r.kept for r in got.values() if r.base_failed)
