"""The corpus pipeline: every stage against brute force, with null and repeated identifiers, copies and repeated rows."""

from __future__ import annotations

import collections
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm.near_dups import LANES, budget_of, close_groups, jaccard_components, near_dedup, shingle_sets, trie_plan, wide_fingerprints

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def norm(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", norm(text))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(sets, least=0.8):
    """Of each set the first one reachable, by comparing all pairs."""
    name = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = [new if n == old else n for n in name]
    return name


def near_copies(rng, groups=12, longest=150):
    rows = []
    for _ in range(groups):
        base = [f"w{k}" for k in rng.integers(0, 3000, int(rng.integers(3, longest)))]
        for changes in (0, 1, 2, 3, 4, 5, 6):
            w = list(base)
            for at in rng.integers(0, len(w), changes):
                w[at] = f"x{rng.integers(10**6)}"
            rows.append(" ".join([*w, *base[:2]]))
    return rows


def test_shingle_sets_and_fingerprints():
    import pyarrow as pa

    texts = ["", " \n", "one", "One  two", "a b c d e", "A B C D E a b c d e", "x " * 400, "é ü ß a b c d É", "last"]
    for at_once in (1 << 22, 3):
        sets = shingle_sets(pa.array([t.encode() for t in texts], pa.large_binary()), 5, at_once)
        assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[4][0] in sets[5]
    long = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, n, dtype=np.uint64)) for k, n in enumerate((1, 254, 255, 256, 1000, 300_000, 3))]
    together = wide_fingerprints([*long, np.zeros(0, np.uint64)])
    assert (together[:-1] == np.concatenate([wide_fingerprints([s]) for s in long])).all()
    assert not together[-1].any()
    assert (wide_fingerprints(long, at_once=10) == together[:-1]).all()


def test_close_groups_match_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (6, LANES), dtype=np.uint64)
    fps = base[rng.integers(6, size=1500)]
    for _ in range(25):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, fps.shape, dtype=np.uint64)) * (rng.random(fps.shape) < 0.5)
    limits = [min(budget_of(64 * (k + 1)), budget_of(64 * LANES)) for k in range(LANES)]
    for part in (fps, fps[:200]):
        spent = np.cumsum(np.bitwise_count(part[:, None] ^ part[None]).astype(int), 2)
        near = (spent <= limits).all(2)
        want = list(range(len(part)))
        todo = set(want)
        while todo:
            first = min(todo)
            seen, wave = {first}, [first]
            while wave:
                wave = [int(y) for x in wave for y in np.flatnonzero(near[x]) if y not in seen and not seen.add(int(y))]
            for x in seen:
                want[x] = first
            todo -= seen
        assert close_groups(part).tolist() == want


def test_node_pairs_end_at_the_budget():
    """Pairs of nodes go down the trie: all pairs within the budget come up, and few of two far halves."""
    from lodestone.llm.near_dups import node_pairs

    rng = np.random.default_rng(8)
    half = rng.integers(0, 1 << 63, (300, LANES), dtype=np.uint64)
    half[:, 0] &= np.uint64((1 << 32) - 1)
    other = half.copy()
    other[:, 0] |= np.uint64(((1 << 32) - 1) << 32)
    keys = np.concatenate([half, other, half[:5], half[:5]])
    keys = keys[np.lexsort(keys.T[::-1])]
    limits = [min(budget_of(64 * (k + 1)), budget_of(64 * LANES)) for k in range(LANES)]
    seen = {(int(a), int(b)) for x, y in node_pairs(keys, limits, lambda: np.arange(len(keys))) for a, b in zip(x, y, strict=True)}
    spent = np.cumsum(np.bitwise_count(keys[:, None] ^ keys[None]).astype(int), 2)
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero((spent <= limits).all(2)), strict=True) if a < b}
    assert near <= seen
    assert len(seen) < 0.6 * len(keys) * (len(keys) - 1) / 2 and all(keys[a, 0] >> np.uint64(32) == keys[b, 0] >> np.uint64(32) for a, b in seen)


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_components_by_rounds_and_in_a_task(spark, monkeypatch, most):
    """The rounds and the task that ends them give the same names, which have a row of their own; few edges need no rounds."""
    from lodestone.llm import components as K

    made = []
    monkeypatch.setattr(K, "MOST_EDGES", most)
    monkeypatch.setattr(K, "materialize", lambda df, name, replaces=None, f=K.materialize: made.append(name) or f(df, name, replaces))
    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (33, 30), (40, 40), (50, 60), (70, 60), (None, 1)]
    got = K.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(k, 0) for k in range(21)] + [(30, 30), (31, 30), (33, 30), (50, 50), (60, 50), (70, 50)]
    assert len(made) == 2 if most > 3 else len(made) > 5


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_few_edges_are_not_shuffled(spark, monkeypatch):
    """Each exchange of a few edges is as many tasks as there are shuffle partitions, all of them work of the driver."""
    from lodestone.llm import components as K

    made = []
    monkeypatch.setattr(K, "materialize", lambda df, name, replaces=None, f=K.materialize: made.append(_exchanges(df)) or f(df, name, replaces))
    got = K.connected_components(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 3), (9, 8)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert (sum(made), _exchanges(got)) == (0, 0)


def test_survivors_are_chosen_in_one_exchange(spark):
    """Besides the two of the join with the names; a null identifier comes last, and equal rows give one."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text + " z", "en", "a", 1), (7, text, "en", "b", 2), (7, text, "en", "b", 2), (9, text + " y", "en", "c", 3), (4, "another one", "en", "d", 4), (None, "alone", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stay = corpus_pipeline.simhash_stage(spark, docs, "")
        assert _exchanges(stay) == 3
        assert sorted(map(tuple, stay.collect()), key=str) == sorted([rows[1], rows[4], rows[5]], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tries_grow_with_the_input():
    assert trie_plan(0) == trie_plan(1)
    plans = [trie_plan(10**k) for k in range(3, 11)]
    assert plans == sorted(plans)


@pytest.mark.parametrize("max_group", [4000, 7])
def test_near_copies_match_all_pairs(spark, max_group):
    texts = [*near_copies(np.random.default_rng(3)), "one"]
    want = components([shingles(t) for t in texts])
    got = {r.doc_id: r.component_id for r in near_dedup(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), max_group=max_group).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts)


def test_recall_of_the_plan():
    """Pairs at 0.8 to 0.9 meet in a trie, with the plans of small and of very large inputs."""
    from lodestone.llm.near_dups import trie_bits

    rng = np.random.default_rng(9)
    pairs = []
    for _ in range(400):
        n = int(rng.integers(40, 400))
        both = max(1, round(n * 0.9))
        one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = np.concatenate([one[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)])
        if len(set(one.tolist()) & set(other.tolist())) >= 0.8 * len(set(one.tolist()) | set(other.tolist())):
            pairs += [np.unique(one), np.unique(other)]
    fps = wide_fingerprints(pairs)
    spent = np.bitwise_count(fps[::2] ^ fps[1::2]).sum(1)
    every = np.unpackbits(fps.view(np.uint8), axis=1)
    for n in (10**4, 256_000, 10**8):
        hit = np.zeros(len(fps) // 2, bool)
        for bits in trie_bits(*trie_plan(n)):
            hit |= (every[::2, bits] == every[1::2, bits]).all(1)
        assert (hit & (spent <= budget_of(64 * LANES))).mean() >= 0.9


def test_large_groups_of_near_copies():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.05], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(300)]
    assert not jaccard_components(sets).any()


def test_stages_match_brute_force(spark):
    rng = np.random.default_rng(4)
    source = lambda: f"src{rng.integers(3)}"
    rows = [(100 + i, t, source()) for i, t in enumerate(near_copies(rng, 6, 40))]
    rows += [(900, "The same words here", "a"), (901, "the SAME words here", "b"), (None, "the same WORDS here", "a"), (-1, "the same words HERE", None)]
    rows += [(910, "Some other words", "a")] * 3 + [(None, "no name but words", "a"), (None, "No name but words", None), (911, "12 !", "a"), (912, None, "a"), (913, "", None), (None, None, None)]
    rows += [(920, "one id, a text", "a"), (920, "one id, another text", "a"), (930, "word " * 30_000, "b")]
    docs = frame(spark, rows).repartition(3)

    # language: what has no letter goes, everything else stays
    kept = corpus_pipeline.language_stage(spark, docs, SF).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter((i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t))

    # exact: one row of each group, that with the largest identifier
    kept = corpus_pipeline.exact_stage(spark, docs, SF).collect()
    best: dict = {}
    for i, t, _ in rows:
        best.setdefault(norm(t), []).append(-(10**9) if i is None else i)
    assert collections.Counter((norm(r.text), -(10**9) if r.doc_id is None else r.doc_id) for r in kept) == collections.Counter((t, max(ids)) for t, ids in best.items())
    assert all((r.doc_id, r.text, r.source) in set(rows) for r in kept)

    # near copies: one row of each component, that with the smallest identifier
    kept = corpus_pipeline.simhash_stage(spark, docs, SF).collect()
    names = components([shingles(t) for _, t, _ in rows])
    low: dict = {}
    for (i, _, _), n in zip(rows, names, strict=True):
        low.setdefault(n, []).append(10**9 if i is None else i)
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in kept) == sorted(min(ids) for ids in low.values())
    assert all((r.doc_id, r.text, r.source) in set(rows) for r in kept)

    # mixing: as many words of each source as its target has, to within the document at its edge; never over twice
    kept = corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    size = lambda t: len((t or "").split())
    given, got = collections.Counter(rows), collections.Counter((r.doc_id, r.text, r.source) for r in kept)
    assert set(got) <= set(given) and all(n <= 2 * given[x] for x, n in got.items())
    assert all(got[x] == n for x, n in given.items() if not size(x[1]))
    targets = {r.source: r.target for r in corpus_pipeline.mix_sources(docs).collect()}
    for s, target in targets.items():
        mine = [x for x in rows if x[2] == s]
        edge = max((given[x] * size(x[1]) for x in mine), default=0)
        assert abs(sum(size(x[1]) * n for x, n in got.items() if x[2] == s) - target) <= edge

    # packing: every document whole, at most 4096 tokens a sequence
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(i for i, _, _ in rows)
    assert max(collections.Counter(r.sequence_id for r in packed for _ in range(r.length)).values()) <= 4096

    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_keeps_clean_documents(spark):
    """On the given tables: exact groups by SQL, near groups by all pairs, and every other document reaches the end."""
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE regexp_matches(text, '\\p{{L}}')").fetchall()
    last: dict = {}
    for i, t in sorted(rows):
        last[norm(t)] = i
    texts = {i: t for t, i in last.items()}
    ids = sorted(texts)
    names = components([shingles(texts[i]) for i in ids])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in docs.collect()) == [ids[n] for n in sorted(set(names))]
    mixed = corpus_pipeline.materialize(corpus_pipeline.mixing_stage(spark, docs, SF), "mixed")
    packed = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r.doc_id for r in mixed.collect())
