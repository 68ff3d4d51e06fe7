"""Packing, sharding, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing, queries
from lodestone.llm.mixing import mix_sources
from lodestone.llm.queries import ORACLE_SQL
from lodestone.llm.sharding import extendible_shards

SF = "/root/testdata/sf0.001"


def fewest(items, capacity):
    """The least number of bins, by trying everything."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def check_packing(items, capacity, optimum):
    """Every piece once, no bin too full, never fewer bins than the optimum, and nothing called proven that isn't."""
    counts = {n: items.count(n) for n in set(items)}
    fillings, bound, proven = packing.bin_completion(counts, capacity)
    used = [n for times, f in fillings for n in f * times]
    assert sorted(used) == sorted(items)
    assert all(sum(f) <= capacity for _, f in fillings)
    bins = sum(times for times, _ in fillings)
    assert bound <= optimum <= bins
    assert not proven or bins == optimum
    return bins, proven


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_optimal(items):
    optimum = fewest(items, 20)
    assert check_packing(items, 20, optimum) == (optimum, True)


def test_bin_completion_of_whole_bins():
    """Bins cut at random: as many bins as were cut are the least. The search ends on nearly all of them, and no proof is false."""
    rng = np.random.default_rng(11)
    met = 0
    for _ in range(300):
        capacity, items = 60, []
        while len(items) < 17:
            cuts = np.unique(rng.integers(8, capacity - 7, rng.integers(1, 4)))
            items += np.diff([0, *cuts.tolist(), capacity]).tolist()
        met += check_packing(items, capacity, sum(items) // capacity)[0] == sum(items) // capacity
    assert met >= 290
    assert check_packing([28, 27, 22, 22, 20, 20, 20, 19, 19, 19, 15, 11, 11, 10, 10, 10, 9, 8], 60, 5) == (5, True)


def test_words_are_encoded_as_in_their_texts():
    vocabulary = packing.default_vocabulary()
    encoder, tokenizer = packing.Encoder(vocabulary), Tokenizer.from_file(vocabulary)
    assert encoder.short

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="aBz'stéßÉ×÷12.,-<|> \t\n\r\x0b\x00ñ한e\u0301", max_size=30), max_size=6))
    def check(texts):
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == want

    check()
    other = packing.Encoder(vocabulary.replace("word_bpe_49k", "byte_bpe_50k"))
    assert not other.short
    assert other.encode(["Some words"]) == [np.array(other.tokenizer.encode("Some words").ids, "<u4").tobytes()]


def test_packing_round_trip(spark):
    text = "Hello, it's größe <|endoftext|> 12 don't " * 3
    rows = [(1, text), (2, None), (3, ""), (4, "word " * 5000), (None, "ß É"), (5, text), (5, text), (6, "日本 ﬁ İ Σς")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, length int")
    got = packing.best_fit_packing(df).collect()
    tok = Tokenizer.from_file(packing.default_vocabulary())
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, ids in want.items():
        expected = sorted((k, at, min(4096, len(x) - at), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for x in ids for k, at in enumerate(range(0, len(x), 4096)))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == expected
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert s[0].offset == 0
        assert all(a.offset + a.length == b.offset for a, b in pairwise(s))
        assert s[-1].offset + s[-1].length <= 4096
    assert packing.best_fit_packing(df.where("false")).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 2000, 300, 1])
def test_shards_match_splitting(spark, limit):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(300)] + [(7, "again"), (7, "again"), (400, None), (401, ""), (402, "é" * 2000), (None, "nobody"), (None, "no other"), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, depth int")
    size = lambda t: len((t or "").encode())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()  # noqa: E731, S324
    bits = lambda i, t: format(int(md5("|" + md5(t or "") if i is None else str(i))[:15], 16), "060b")
    want = {}

    def split(part, prefix):
        total = sum(size(t) for _, t in part)
        if total <= limit or len(prefix) == 60:
            want.update({(i, size(t)): (prefix, total) for i, t in part})
            return
        for b in "01":
            split([r for r in part if bits(*r)[len(prefix)] == b], prefix + b)

    split(rows, "")
    got = extendible_shards(df, max_bytes=limit).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.bytes): (r.shard, r.shard_bytes) for r in got} == want
    assert extendible_shards(df.where("false")).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 30)), f"s{i % 5}") for i in range(500)] + [(900, None, "s0"), (901, "a b", None), (902, "", "s9"), (None, "x y z", "s1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, part int")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    names = ["s0", "s1", "s2", "s3", "s4", "s9", None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
    stop = [False] * len(names)
    while True:
        left = 1.5 * sum(sizes) - sum(2 * s for s, x in zip(sizes, stop, strict=True) if x)
        share = left / (sum(w for w, x in zip(weights, stop, strict=True) if not x) or 1)
        more = [x or share * w > 2 * s for x, w, s in zip(stop, weights, sizes, strict=True)]
        if more == stop:
            break
        stop = more
    target = {n: 2 * s if x else share * w for n, s, x, w in zip(names, sizes, stop, weights, strict=True)}
    for n in names:
        mine = [r for r in got if r.source == n]
        assert mine[0].target == pytest.approx(target[n])
        assert sum(r.taken for r in mine) == pytest.approx(target[n], abs=1)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    again = {(r.doc_id, r.source, r.taken) for r in mix_sources(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.source, r.taken) for r in got}
    assert mix_sources(df.where("false")).count() == 0


def test_sampling_prefers_quality(spark):
    df = spark.createDataFrame([(i, "w", "a") for i in range(2000)] + [(9000 + i, "w", "b") for i in range(9000)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 1.0 if i % 2 else 0.1) for i in range(11000 + 8000)], "doc_id long, quality double")
    got = [r for r in mix_sources(df, quality=quality, weights=(1, 9), share=0.5).collect() if r.source == "a" and r.taken]
    assert sum(r.doc_id % 2 for r in got) > 0.8 * len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_queries_match_sql(spark, name, sf):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in cols]) for r in cur.fetchall())


def test_linked_vectors_match_sql(spark, tmp_path):
    """The given small tables hold no links; these do, with copies, scaled copies and repeated rows."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + 0.07 * rng.normal(size=16)], i % 3) for i in range(240)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(6)] + [(400, [2 * x for x in rows[0][1]], 0), (401, None, 0), (402, [0.0] * 16, 0), (403, rows[0][1], None), (404, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op2_embedding_dedup"]).fetchall())
    assert sum(r[1] for r in want) > 500
    from lodestone.llm.cover_tree import embedding_dedup

    assert sorted(map(tuple, queries.QUERIES["op2_embedding_dedup"](spark, str(tmp_path)).collect())) == want
    for block in (40, 5):
        assert sorted(map(tuple, embedding_dedup(df, least=0.93, block=block).collect())) == want
    again = sorted(map(tuple, embedding_dedup(df.unionAll(df.where("vec_id = 0")), least=0.93).where("vec_id = 0").collect()))
    assert again == [(0, want[0][1] + 1, want[0][2], want[0][3])] * 2


def test_sql_of_shards_with_pages_and_large_rows(spark):
    rows = [(i, "x" * 30_000) for i in range(120)] + [(7, "y" * 700_000), (7, "z" * 700_001), (7, "y" * 700_002), (500, "w" * 1_500_000), (None, "n" * 10), (None, None), (None, "n" * 10), (501, None), (502, "é" * 1000)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    cur = con.execute(ORACLE_SQL["op6_extendible_shards"])
    names = [d[0] for d in cur.description]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bytes int").repartition(3)
    got = extendible_shards(docs, max_bytes=1 << 20).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))
    assert {r.page for r in got} == {0, 1} and any(r.shard_bytes == 1_500_000 for r in got)
