"""Near copies at a Jaccard similarity: wide SimHash fingerprints, joined by several binary tries, then compared exactly.

Fingerprints of 64 bits can't tell similarities of 0.8 from lesser ones with a
small bit budget, so a set of word shingles gets ``LANES`` words of 64 bits
here. Bits of two sets agree with a probability that follows from their
similarity (Charikar); ``tries`` binary tries, each over bits of its own, are
joined with themselves as deep as the number of sets asks for, and as many of
them that a pair at the similarity meets in one with probability ``RECALL``.
Below a node that they share, pairs of nodes of the trie over the whole
fingerprint descend together, add up the bits in which they differ, and end
where the budget is exceeded: four standard deviations above what a pair at the
similarity has. What the tries link forms
groups, and in a group all pairs whose rarest shingles meet are compared shingle
by shingle, so that every link is an exact one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, releasing, row_key
from .components import connected_components
from .simhash import _Forest, _runs

#: The similarity from which sets link, as a fraction.
LEAST = (4, 5)
LANES = 4
#: Share of the pairs at ``LEAST`` that meet in a trie, and about how many unrelated sets share a node there.
RECALL, BESIDE = 0.99, 256
#: Rows of 48 bytes that are broadcast at most.
MOST_BROADCAST = 300_000
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(42)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=U)
_TERM = _RANDOM.integers(0, 1 << 64, 64, dtype=U) | U(1)
_LANE = _RANDOM.integers(0, 1 << 64, 16, dtype=U)
_BASE = int(_RANDOM.integers(0, 1 << 63)) * 2 + 1
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    """MurmurHash3's finalizer."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo two to the 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, U(base))
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=U))
    return _POWERS


def shingle_sets(texts: pa.Array, shingle: int, at_once: int = 1 << 20) -> list[np.ndarray]:
    """For each text (binary) the sorted hashes of its distinct shingles; fewer words than ``shingle`` are one shingle, no words none.

    A word's hash is polynomial over its bytes, A-Z lower-cased, so that all
    words of many texts are hashed by running sums.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + at_once, "right")) - 1)
        out += _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
        lo = hi
    if _POWERS and len(_POWERS[0]) > 4 * at_once:  # of a very long text
        _POWERS.clear()
    return out


def _sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> list[np.ndarray]:
    n = len(data)
    forward, back = _powers(n + 1)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end[:-1] &= ~inside[1:] | cut[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[_LOWER[data]] * forward[:n], out=sums[1:])
    word = _mix((sums[end] - sums[begin]) * back[begin])
    m = max(0, len(word) - shingle + 1)
    joined = np.zeros(m, U)
    for j in range(shingle):
        joined = _mix(joined + word[j : j + m] * _TERM[j])
    first = np.searchsorted(begin, bounds)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            s = np.sort(joined[a : b - shingle + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            s = np.full(min(1, b - a), U(b - a))
            for k in range(a, b):
                s = _mix(s * _TERM[-1] + word[k])
            out.append(s)
    return out


def wide_fingerprints(sets: list[np.ndarray], lanes: int = LANES, at_once: int = 1 << 15) -> np.ndarray:
    """SimHash of each set, ``lanes`` words of 64 bits: a bit is 1 if over half of the shingles' hashes have it."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    total = np.append(0, np.cumsum(size))
    out = np.zeros((len(sets), lanes), U)
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + at_once, "right")) - 1)
        some = np.flatnonzero(size[lo:hi])
        n = size[lo:hi][some]
        counts = np.zeros((len(some), 64 * lanes), np.int64)
        flat = np.concatenate(sets[lo:hi])
        ends = np.cumsum(n)
        for at in range(0, len(flat), 1 << 17):  # one very long set alone comes in parts
            part = flat[at : at + (1 << 17)]
            words = np.stack([_mix(part + _LANE[k]) for k in range(lanes)], 1)
            bits = np.unpackbits(words.view(np.uint8), axis=1).view(U)  # a byte for each bit: eight are added at a time
            lows = np.unique(np.concatenate([np.clip(ends - n - at, 0, len(part)), np.arange(0, len(part), 255)]))
            # stretches of one set and of at most 255 rows
            lows = lows[lows < len(part)]
            sums = np.add.reduceat(bits, lows, axis=0).view(np.uint8).reshape(len(lows), 64 * lanes)
            np.add.at(counts, np.searchsorted(ends, lows + at, "right"), sums)
        out[lo + some] = np.packbits(2 * counts > n[:, None], axis=1).view(U).reshape(-1, lanes)
        lo = hi
    return out


def agreement(similarity: float) -> float:
    """Probability that a bit agrees, for sets of one size."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def trie_plan(n: int) -> tuple[int, int]:
    """How deep the tries are joined for ``n`` sets, and how many there are."""
    depth = min(48, max(6, math.ceil(math.log2(max(n, 1) / BESIDE))))
    return depth, math.ceil(math.log(1 - RECALL) / math.log(1 - agreement(LEAST[0] / LEAST[1]) ** depth))


def budget_of(bits: int) -> int:
    """Bits in which pairs at ``LEAST`` differ, and four standard deviations more."""
    q = 1 - agreement(LEAST[0] / LEAST[1])
    return int(bits * q + 4 * math.sqrt(bits * q * (1 - q)))


def trie_bits(depth: int, tries: int, lanes: int = LANES) -> np.ndarray:
    """The bits of each trie, drawn without repeats as long as there are any."""
    random, deck = np.random.default_rng(7), []
    while len(deck) < depth * tries:
        deck.extend(random.permutation(64 * lanes).tolist())
    out, at = [], 0
    for _ in range(tries):
        mine: list[int] = []
        while len(mine) < depth:
            bit = deck[at] if at < len(deck) else int(random.integers(64 * lanes))
            at += 1
            if bit not in mine:
                mine.append(bit)
        out.append(mine)
    return np.array(out)


def node_pairs(keys: np.ndarray, limits: list[int], one, *, leaf: int = 64, batch: int = 1 << 17):
    """Joins the binary trie of the sorted ``keys``, of several words each, with itself: yields arrays ``x, y`` of positions to compare.

    Pairs of nodes descend together bit by bit, add up the bits in which their
    paths differ, and end where these exceed the limit of the word that they are
    in. A pair of nodes with ``leaf`` or fewer pairs of keys gives them up; nodes
    below which all bits are spent hold copies, and give up a chain. Pairs of
    nodes that ``one()``, a number for each key's component, knows as one
    component link nothing new and end too. A node is a range of the keys; the
    frontier holds at most ``batch`` pairs at once, the rest waits.
    """
    m, lanes = keys.shape
    stack = [(0, np.array([[0, m, 0, m, 0]]))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > batch:
            stack.append((depth, pairs[batch:]))
            pairs = pairs[:batch]
        part = one()
        changes = np.append(0, np.cumsum(part[1:] != part[:-1]))
        a0, a1, b0, b1, _ = pairs.T
        pairs = pairs[~((changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (part[a0] == part[b0]))]
        a0, a1, b0, b1, spent = pairs.T
        if depth == 64 * lanes:
            own = a0 == b0
            yield a0[~own], b0[~own]
            for lo, hi in pairs[own][:, :2]:
                yield np.arange(lo, hi - 1), np.arange(lo + 1, hi)
            continue
        wide = b1 - b0
        few = (a1 - a0) * wide <= leaf
        if few.any():
            n = ((a1 - a0) * wide)[few]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(wide[few], n)
            x, y = np.repeat(a0[few], n) + at // each, np.repeat(b0[few], n) + at % each
            yield x[x < y], y[x < y]
        a0, a1, b0, b1, spent = pairs[~few].T
        if not len(a0):
            continue
        ones = np.append(0, np.cumsum((keys[:, depth // 64] >> U(63 - depth % 64)) & U(1)).astype(np.int64))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        parts = []
        for x0, x1, y0, y1, more, keep in ((a0, am, bm, b1, 1, True), (am, a1, b0, bm, 1, ~own), (a0, am, b0, bm, 0, True), (am, a1, bm, b1, 0, True)):
            keep = keep & (x1 > x0) & (y1 > y0) & (spent + more <= limits[depth // 64]) & ~((x0 == y0) & (x1 - x0 == 1))
            parts.append(np.stack([x0[keep], x1[keep], y0[keep], y1[keep], spent[keep] + more], 1))
        made = np.concatenate(parts)
        if len(made):
            stack.append((depth + 1, made))


def close_groups(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint the first one reachable by pairs within the budget, by the trie of all fingerprints joined with itself.

    After each word a pair may have spent no more than that word's budget.
    Neighbours in the order are compared first, which joins most of a group of
    copies, so that the pairs of its nodes end early.
    """
    m, lanes = fps.shape
    forest = _Forest(m)
    if m < 2:
        return forest.up
    limits = [min(budget_of(64 * (k + 1)), budget_of(64 * lanes)) for k in range(lanes)]
    order = np.lexsort(fps.T[::-1])
    keys = fps[order]

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        spent = np.zeros(len(x), np.int64)
        for k in range(lanes):
            spent = spent + np.bitwise_count(keys[x, k] ^ keys[y, k])
            near = spent <= limits[k]
            x, y, spent = x[near], y[near], spent[near]
        forest.union(order[x], order[y])

    compare(np.arange(m - 1), np.arange(1, m))
    for x, y in node_pairs(keys, limits, lambda: forest.up[order]):
        compare(x, y)
    return forest.up


def _postings(bits: np.ndarray):
    tries, depth = bits.shape
    weight = (1 << np.arange(depth, dtype=np.int64))[::-1]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
            every = np.unpackbits(fps, axis=1)
            unit = np.concatenate([every[:, bits[t]].astype(np.int64) @ weight + (t << 48) for t in range(tries)])
            again = pa.array(np.tile(np.arange(n), tries))
            yield pa.RecordBatch.from_arrays([pa.array(unit), batch.column(0).take(again), batch.column(1).take(again)], names=["unit", "node", "fp"])

    return run


def _by_unit(close, keys: int, columns: int, names: list[str]):
    """Calls ``close(columns of the rows of a unit)``; rows come in the order of the ``keys`` first columns."""

    def run(batches):
        at, held = None, []

        def closed():
            return close([pa.concat_arrays([h[k] for h in held]) for k in range(columns)])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            change = np.zeros(batch.num_rows - 1, bool)
            for v in values:
                change |= v[1:] != v[:-1]
            cuts = np.flatnonzero(change) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                key = tuple(v[lo] for v in values)
                if held and key != at:
                    if (made := closed()) is not None:
                        yield made
                    held = []
                at = key
                held.append([batch.column(keys + k).slice(lo, hi - lo) for k in range(columns)])
        if held and (made := closed()) is not None:
            yield made

    return run


def _edges(node: pa.Array, up: np.ndarray) -> pa.RecordBatch | None:
    differ = np.flatnonzero(up != np.arange(len(up)))
    return pa.RecordBatch.from_arrays([node.take(pa.array(differ)), node.take(pa.array(up[differ]))], names=["a", "b"]) if len(differ) else None


def _close(columns):
    node, fp = columns
    fps = np.frombuffer(b"".join(fp.to_pylist()), U).reshape(len(fp), -1)
    return _edges(node, close_groups(fps)) if len(node) > 1 else None


def _linked(columns):
    node, sets = columns
    return _edges(node, jaccard_components([np.frombuffer(s, U) for s in sets.to_pylist()]))


def _prefix_length(n: int) -> int:
    return n - -(-LEAST[0] * n // LEAST[1]) + 1 if n else 0


def jaccard_components(sets: list[np.ndarray]) -> np.ndarray:
    """For each of the sorted sets the position of the first one reachable by links of ``LEAST`` or more. Sets with such a link share one of their rarest shingles."""
    n = len(sets)
    forest = _Forest(n)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets) if n else np.zeros(0, U)
    ends = np.cumsum(size)
    values, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(values))
    sets = [np.sort(rank[at[e - k : e]]) for e, k in zip(ends, size, strict=True)]  # the rarest first
    prefixes = [s[: _prefix_length(len(s))] for s in sets]
    owner = np.repeat(np.arange(n), [len(p) for p in prefixes])
    every = np.concatenate(prefixes) if n else owner
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    lo, hi = np.searchsorted(every, np.arange(len(values))), np.searchsorted(every, np.arange(len(values)), "right")
    open_ = hi - lo > 1  # shingles at which more than one component meets
    for x in range(n):
        mine = [owner[lo[h] : hi[h]] for h in prefixes[x][open_[prefixes[x]]]]
        if not mine:
            continue
        near = np.unique(np.concatenate(mine))
        near = near[(near > x) & (forest.up[near] != forest.up[x]) & (LEAST[1] * np.minimum(size[near], size[x]) >= LEAST[0] * np.maximum(size[near], size[x]))]
        if len(near):
            theirs = np.concatenate([sets[y] for y in near])
            hit = sets[x][np.minimum(np.searchsorted(sets[x], theirs), size[x] - 1)] == theirs
            both = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(size[near])[:-1]))
            near = near[LEAST[1] * both >= LEAST[0] * (size[near] + size[x] - both)]
            forest.union(near, np.full(len(near), x))
        for h in prefixes[x][open_[prefixes[x]]]:
            part = forest.up[owner[lo[h] : hi[h]]]
            open_[h] = (part != part[0]).any()
    return forest.up


def _sliced(rows: DataFrame, by: str, most: int, name: str) -> tuple[DataFrame, list[str]]:
    """Rows with the pair of slices ``i, j`` they are compared in. A value of ``by`` with over ``most`` rows is cut in slices, and each pair of slices is a unit of its own."""
    large = materialize(rows.groupBy(by).agg(F.ceil(F.count("*") / most).cast("int").alias("m")).where("m > 1"), name)
    cut = rows.join(large, by, "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).where("m = 1 or own <> other")
    return cut.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("m", "own", "other"), [by, "i", "j"]


def trie_groups(nodes: DataFrame, n: int, most: int = 20_000) -> DataFrame:
    """``(node, component)`` of the ``nodes(node, fp)`` that share a trie node with another one within the budget."""
    depth, tries = trie_plan(n)
    postings = nodes.select("node", "fp").mapInArrow(releasing(_postings(trie_bits(depth, tries))), "unit long, node binary, fp binary")
    units, keys = _sliced(postings, "unit", most, "near-hot")
    met = units.select(*keys, "node", "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(_by_unit(_close, 3, 2, ["a", "b"])), "a binary, b binary")
    return connected_components(met)


def _marks(shingle: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.large_binary()).fill_null(b""), shingle)
            node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fps = wide_fingerprints(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.binary()), pa.array([f.tobytes() for f in fps], pa.binary())], names=["key", "id", "node", "fp"])

    return run


def _made_sets(shingle: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.large_binary()).fill_null(b""), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "near", "shingles"])

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _split(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``key, id, row, node, near`` of every row, ``near`` null for those whose node met no other and has no copy. Texts move once."""
    keyed = _keyed(docs, doc_id, text)
    marked = materialize(keyed.select("key", F.col("row")[text].cast("binary").alias("text"), "id").mapInArrow(releasing(_marks(shingle)), "key binary, id long, node binary, fp binary"), "near-marks")
    nodes = materialize(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.count("*").alias("copies")), "near-nodes")
    met = trie_groups(nodes, nodes.count())
    groups = nodes.select("node", "copies").join(met, "node", "left").where("component is not null or copies > 1").select("node", F.coalesce("component", "node").alias("near"))
    found = materialize(marked.select("key", "node").join(groups, "node").distinct(), "near-groups")
    # texts stay where they are while what is said of them is small; beyond that they move once
    few = found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    split = materialize(keyed.join(F.broadcast(found) if few else found, "key", "left"), "near-split")
    forget(marked, nodes, found)
    return split


def _verified(split: DataFrame, text: str, shingle: int, max_group: int) -> DataFrame:
    """``(node, component)`` for all nodes with a ``near`` group, by exact comparison inside the groups."""
    some = split.where("near is not null")
    texts = some.groupBy("node", "near").agg(F.first(F.col("row")[text]).alias("text"))
    sets = texts.select("node", F.col("text").cast("binary").alias("text"), "near").mapInArrow(releasing(_made_sets(shingle)), "node binary, near binary, shingles binary")
    sets = materialize(sets, "near-sets")
    units, keys = _sliced(sets, "near", max_group, "near-large")
    links = units.select(*keys, "node", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(_by_unit(_linked, 3, 2, ["a", "b"])), "a binary, b binary")
    parts = connected_components(links)
    named = materialize(sets.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "near-named", replaces=sets)
    return named


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = 5, max_group: int = 4000) -> DataFrame:
    """One row for each input row: ``doc_id, component_id, kept``.

    Words are those of ``simhash``. Documents link where the sets of their
    shingles have a Jaccard similarity of 0.8 or more and a trie lets them meet,
    as ``RECALL`` of the pairs at 0.8 do and nearly all above; equal sets always
    link, and documents without words link with each other. ``component_id`` is
    the smallest identifier reachable, null where no row of the component has
    one; ``kept`` marks each row that bears its component's name. Repeated rows
    are copies; an empty table gives an empty result; texts of any length are
    taken whole; columns with any name do no harm. A group with more than
    ``max_group`` sets is cut in slices, and each pair of slices is a unit.
    """
    split = _split(docs, doc_id, text, shingle)
    named = _verified(split, text, shingle, max_group)
    some = split.where("near is not null").select("id", "node").join(named, "node")
    names = some.groupBy("component").agg(F.min("id").alias("component_id"))
    some = some.join(names, "component").select(F.col("id").alias("doc_id"), "component_id")
    alone = split.where("near is null").select(F.col("id").alias("doc_id"), F.col("id").alias("component_id"))
    return alone.unionByName(some).select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = 5, max_group: int = 4000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component of ``near_dedup`` one, that with the smallest identifier (null ones last), of several the first by a hash of the text."""
    split = _split(docs, doc_id, text, shingle)
    named = _verified(split, text, shingle, max_group)
    some = split.where("near is not null").join(named, "node")
    stay = some.groupBy("component").agg(F.min_by("row", F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("row")).select("row.*")
    return split.where("near is null").select("row.*").unionAll(stay)
