"""Exact, SimHash and embedding deduplication against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.components import connected_components
from lodestone.llm.cover_tree import CoverTree, dual_traversal, embedding_dedup
from lodestone.llm.exact_dedup import PatriciaTrie, Tries, exact_dedup, exact_survivors
from lodestone.llm.queries import ORACLE_SQL
from lodestone.llm.simhash import fingerprint, simhash_dedup, trie_components, trie_links

DOCS = "doc_id long, text string, owner string, fp long, component_id string"


def docs(spark, rows):
    """With further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], DOCS)


@given(st.lists(st.binary(max_size=6), max_size=60))
def test_trie_is_a_dictionary(keys):
    trie, seen = PatriciaTrie(), {}
    for k in keys:
        terminal, new = trie.insert(k)
        assert new == (k not in seen)
        assert seen.setdefault(k, terminal) is terminal
    assert trie.size == len(seen)


def check_exact(rows, got):
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        (text,) = [t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in groups[text] if i is not None]
        assert (r.group_size, r.keep_id) == (len(groups[text]), max(ids, default=None))
        kept[text] = kept.get(text, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}


EXACT = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, ""), (6, None), (7, "abc"), (7, "abc"), (None, "abc"), (8, "x" * 100_000), (9, "X" * 100_000), (None, None), (10, "abd")]


def test_exact(spark):
    check_exact(EXACT, exact_dedup(docs(spark, EXACT).repartition(3)).collect())


def test_exact_with_spills_and_weak_hashes(spark):
    source = docs(spark, EXACT).coalesce(1)
    check_exact(EXACT, exact_dedup(source, budget=1).collect())
    check_exact(EXACT, exact_dedup(source, hashed=lambda body: "same").collect())


def test_tries_branch_and_spill_by_subtree():
    trie = PatriciaTrie()
    keys = [b"", b"abc", b"abd", b"ab", b"b" * 900, b"abc" + b"x" * 50, b"b" * 901, b"\x00"]
    for k in keys:
        trie.insert(k, 10)[0].rows.append(k)
    assert trie.size == len(keys) and len(trie.root) == 3  # many strings in one trie, parted where they differ
    assert trie.held[ord("b")] == 2 * 210 + 1801
    assert {(k, t.rows[0]) for k, t in trie.take(ord("b"))} == {(b"b" * 900, b"b" * 900), (b"b" * 901, b"b" * 901)}
    assert ord("b") not in trie.root and ord("b") not in trie.held
    assert sorted(k for f in list(trie.held) for k, _ in trie.take(f)) == sorted(k for k in keys if not k.startswith(b"b"))
    tries = Tries(3000)
    for k in keys * 2:
        tries.insert(k, 5).rows.append(k)
    spilled = {k for k, _ in tries.spill()}
    assert b"b" * 901 in spilled and b"" not in spilled and tries.held <= 1500  # the largest go first
    assert spilled | {k for k, _ in tries.spill(True)} == set(keys)


def test_survivors_by_both_passes(spark):
    texts = [(i, f"{'ab' * (i % 9)}{i % 13}") for i in range(300)] + [(None, None), (400, ""), (401, "x" * 50_000), (402, "X" * 50_000), (7, "ab1")]
    source = spark.createDataFrame([(t, i, 1) for i, t in texts], "text string, doc_id long, n_bytes int").repartition(5)
    want = {}
    for i, t in texts:
        want[(t or "").lower()] = max(want.get((t or "").lower(), -1), -1 if i is None else i)
    for budget in (1, 5000, 32 << 20):
        got = exact_survivors(source, budget=budget).collect()
        assert sorted(((r.text or "").lower(), r.doc_id) for r in got) == sorted(want.items())


def test_sql_agrees_on_repeats_and_nulls(spark):
    rows = [*EXACT, (None, "only null"), (None, "ONLY null"), (20, "same"), (20, "same"), (20, "Same")]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    cur = con.execute(ORACLE_SQL["op5_exact_dedup"])
    names = [d[0] for d in cur.description]
    got = exact_dedup(docs(spark, rows).repartition(3)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_exact_smallest_and_empty(spark):
    got = exact_dedup(docs(spark, [(1, "a"), (2, "A"), (3, "b")]), keep="smallest").collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    assert exact_dedup(docs(spark, [])).count() == 0


def plain_fingerprint(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = ([" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]) if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB É\t\n\x0b ", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text, 4)


def linked(keys, budget):
    """Smallest key of each component, by trying all pairs."""
    up = {int(k): int(k) for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in up:
        for b in up:
            if a < b and (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in up}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 63), max_size=6)), max_size=40), st.integers(0, 6))
def test_trie_self_join(parts, budget):
    bases = (0, (1 << 64) - 1, 0x123456789ABCDEF0, 0xFFFF)
    keys = np.unique(np.array([bases[b] ^ sum(1 << f for f in set(flips)) for b, flips in parts], np.uint64))
    up = trie_components(keys, budget)
    want = linked(keys, budget)
    assert {int(k): int(keys[r]) for k, r in zip(keys, up, strict=True)} == want


def test_trie_links_in_slices(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    keys = sorted({base ^ sum(1 << int(f) for f in rng.integers(0, 20, 3)) for _ in range(200)} | {int(x) for x in rng.integers(1 << 62, size=50)})
    fps = spark.createDataFrame([(k,) for k in keys], "fp long")
    want = linked(keys, 4)
    for most in (20_000, 40):
        got = {r.node: r.component for r in connected_components(trie_links(fps, 4, most)).collect()}
        assert {k: got.get(k, k) for k in keys} == want


def test_block_values_in_portions():
    import pyarrow as pa

    from lodestone.llm.simhash import _joined

    rng = np.random.default_rng(6)
    rows = sorted((int(t), 0, 0, int(v), int(fp)) for t in range(2) for v in rng.integers(0, 12, 40) for fp in (int(v) << 52 | int(x) for x in rng.integers(0, 40, 4)))
    rows = [(t, i, j, fp >> 52 if t == 0 else fp >> 40 & 4095, fp) for t, i, j, _, fp in rows]
    rows.sort()
    table = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 7], strict=True)], names=list("tijvf")) for k in range(0, len(rows), 7)]

    def groups(most):
        up = {}
        find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
        for b in _joined(4, most)(iter(table)):
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, q = find(x), find(y)
                up[max(p, q)] = min(p, q)
        return {x: find(x) for x in sorted(up)}

    want = groups(1 << 20)
    assert len(want) > 20
    for most in (1, 5, 50):
        assert groups(most) == want


def test_simhash(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long.replace("w7 ", "v7 ")), (9, long.upper()), (4, None), (2, " \n"), (8, "one two"), (None, "one  two"), (6, "other words are here now"), (6, "other words are here now")]
    got = simhash_dedup(docs(spark, rows), shingle=4, budget=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert len(got) == len(rows)
    assert by[9].component_id == by[5].component_id == (3 if (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() <= 4 else 5)
    assert by[4].component_id == by[2].component_id == 2
    assert by[4].fingerprint == "0" * 16
    assert by[None].component_id == by[8].component_id == 8
    assert by[None].kept is False
    assert by[6].kept
    assert simhash_dedup(docs(spark, [])).count() == 0


def test_components(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 100 for i in range(100, 130)}


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.sampled_from([0.5, 0.93, 0.999]))
def test_dual_traversal_finds_exact_pairs(seed, n, least):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 8))
    x = unit(centres[rng.integers(3, size=n)] + rng.choice([0.01, 0.3, 2.0], size=(n, 1)) * rng.normal(size=(n, 8)))
    tree = CoverTree(x)
    found = []
    for a, b, whole in dual_traversal(tree, tree, least):
        if not whole:
            found += [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)]
        elif len(a) == len(b) and (a == b).all():
            found += [(min(p, q), max(p, q)) for k, p in enumerate(a.tolist()) for q in a.tolist()[k + 1 :]]
        else:
            found += [tuple(sorted((p, q))) for p in a.tolist() for q in b.tolist()]
    assert len(found) == len(set(found))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if x[i] @ x[j] >= least}
    edge = {(i, j) for i in range(n) for j in range(i + 1, n) if abs(x[i] @ x[j] - least) < 1e-8}
    assert set(found) - edge == want - edge


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 16))
    rows = [(i, (base[i % 4] + 0.05 * rng.normal(size=16)).tolist(), i % 2) for i in range(60)]
    rows += [(100 + i, rows[0][1], 0) for i in range(5)]  # copies
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 0), (204, [None] * 16, 0), (205, rows[0][1], None), (None, rows[0][1], 0), (206, [float("inf")] * 16, 0)]
    schema = "vec_id long, embedding array<double>, label int, cls string, x string"
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], schema)
    for block in (4096, 8):
        got = {(r.vec_id): r for r in embedding_dedup(df, block=block).collect()}
        assert len(got) == len(rows)
        fine = [(i, np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
        near = lambda a, b: a[2] == b[2] and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93
        for a in fine:
            assert got[a[0]].n_links == sum(near(a, b) for b in fine) - 1
        for i in (200, 201, 202, 203, 204, 205, 206):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[103].component_id == got[0].component_id == 0
        assert got[None].component_id == 0
    assert embedding_dedup(df.where("false")).count() == 0
