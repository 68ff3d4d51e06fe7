"""The divergence audit against plain counting over all terms and pairs, and against its SQL."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from lodestone.llm import divergence
from lodestone.llm.divergence import counted, document_frequency_sketch, long_text, source_divergence
from lodestone.llm.queries import ORACLE_SQL, QUERIES

ROWS = "doc_id long, text string, lang string, source string, term string, p long, df int"


def count_terms(text):
    return Counter(re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.lower()))


def frame(spark, rows):
    """With further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, la, s, "t", 1, 2) for i, (t, la, s) in enumerate(rows)], ROWS)


def plain(rows, least=3, top=200):
    by_lang, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        groups[lang or "", source or ""].update(terms)
        by_lang[lang or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = share(counts), share(by_lang[lang])
        f = lambda a, b: (a - b) ** 2 // b
        pair = []
        for la, other in groups:
            if la == lang and other != source:
                theirs = share(groups[la, other])
                pair.append((sum(f(p[t], theirs[t]) for t in kept), other))
        term = [(f(p[t], q[t]), t) for t in kept if counts[t] and p[t] > q[t]]
        for part, found in (("pair", pair), ("term", term)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, n) for n, (value, item) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


def agree(got, rows, **options):
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == plain(rows, **options)


ODD = [
    ("a b c", "en", "x"), ("A B d", "en", "x"), ("a b É é", "en", "y"), ("é a_b1c", "en", "y"), ("é É", "en", "z"), ("", "en", "empty"), (None, "en", "null text"),
    ("a a a", None, None), ("a a a", None, "s"), ("a", "", ""), ("only here", "fr", "x"), ("", "fr", "y"), ("1 2 3", "es", "alone"),
    ("日本 日本！ café", "en", "x"), ("日本！", "en", "y"), ("日本！", "en", "z"), ("word " * 50_000, "en", "z"), ("word", "en", "y"), ("word", "en", "y"), ("word", "en", "y"),
]


def test_odd_rows(spark):
    agree(source_divergence(frame(spark, ODD).repartition(4)).collect(), ODD)


@pytest.mark.parametrize("width", [1, 64])
def test_no_result_hangs_on_the_sketch(spark, width, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 16)
    monkeypatch.setattr(divergence, "HELD", 2)
    agree(source_divergence(frame(spark, ODD).repartition(3), width=width, top=2).collect(), ODD, top=2)


def test_empty_table(spark):
    assert source_divergence(frame(spark, [])).collect() == []


def test_sketch_never_underestimates(spark):
    rows = [(f"w{i % 7} v{i} u{i // 2}".replace("0", "o").translate({48 + d: 97 + d for d in range(10)}), "en", "s") for i in range(60)]
    texts = frame(spark, rows).selectExpr("cast(lang as binary) lang", "cast(source as binary) source", "cast(text as binary) text").repartition(5)
    table = document_frequency_sketch(texts, 3, 256)
    df = Counter(t for text, _, _ in rows for t in set(count_terms(text.encode())))
    keys = list(df)
    at = divergence.cells(b"en", keys, 256)
    for j, k in enumerate(keys):
        assert min(table[c] for c in at[:, j]) >= min(df[k], 3)


def test_slices_cut_between_terms(monkeypatch):
    texts = [("Ab céd " * 40 + "x" * 100 + " tail").encode(), b"", b"one", " É é A_b1c\x7fd".encode(), b"one two one"]
    langs, sources = [b"a", b"a", b"b", b"a", b"b"], [b"s", b"t", b"s", b"s", b"s"]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([b"z", *langs], [b"z", *sources], [b"z", *texts])], names=["lang", "source", "text"]).slice(1)
    want = {}
    for lang, source, t in zip(langs, sources, texts, strict=True):
        for term, n in count_terms(t).items():
            df, all_n = want.get((lang, source, term), (0, 0))
            want[lang, source, term] = (df + 1, all_n + n)
    for size in (1, 2, 3, 7, 50, 1 << 20):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert long_text(texts[0]) == count_terms(texts[0])
        groups, got = {}, {}
        for g, terms, df, n in counted(batch, groups, (0, 1)):
            for k, t, d, c in zip(g.tolist(), terms.to_pylist(), df.tolist(), n.tolist(), strict=True):
                key = (*list(groups)[k], t)
                got[key] = (got.get(key, (0, 0))[0] + d, got.get(key, (0, 0))[1] + c)
        assert got == want


def test_sql_states_the_same(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op12_source_divergence"](spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["op12_source_divergence"]).fetchall())


def test_sql_of_odd_rows():
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[k] for r in ODD], pa.string()) for k, c in enumerate(("text", "lang", "source"))}))
    assert sorted(con.execute(ORACLE_SQL["op12_source_divergence"]).fetchall()) == plain(ODD)
