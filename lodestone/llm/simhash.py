"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

The trie of all distinct 64-bit fingerprints is dealt out by exact blocks: with
a budget of ``k`` bits, two linked fingerprints agree on one of ``k + 1`` blocks,
so the trie is rotated to start at each block in turn, and a task gets the
subtrees below equal blocks. There, pairs of nodes descend together, add up the
bits in which they differ, and end where the budget is exceeded. Where the
budget covers all bits that are left, the two subtrees are joined whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing
from .components import _Forest, connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of a text: a bit is 1 if over half of the shingles' XXH64 have it."""
    found = WORD.findall((text or "").encode().lower())
    if not found:
        return 0
    return _fingerprint(found, shingle)


def _fingerprint(found: list[bytes], shingle: int) -> int:
    n = len(found) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    digest = xxhash.xxh64_digest
    joined = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    raw = np.frombuffer(b"".join([digest(x, SEED) for x in joined]), np.uint8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 8 << 13):
        counts += np.unpackbits(raw[at : at + (8 << 13)]).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            made = np.fromiter(((_fingerprint(f, shingle) if (f := WORD.findall((x.as_py() or b"").lower())) else 0) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return run


def trie_components(keys: np.ndarray, budget: int, nodes: np.ndarray | None = None, depth: int = 0, *, batch: int = 1 << 17) -> np.ndarray:
    """For each of the sorted distinct ``uint64`` keys the position of the smallest key reachable by links of at most ``budget`` bits below the given nodes.

    A node is a range of the sorted keys at a depth; ``nodes`` are the starts of
    the nodes to begin with (the root by default). The frontier holds pairs of
    nodes of one depth with the bits in which their paths differ.
    """
    n = len(keys)
    forest = _Forest(n)
    if n < 2:
        return forest.up
    lo = np.zeros(1, np.int64) if nodes is None else nodes
    hi = np.append(lo[1:], n)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)], 1))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > batch:  # bounded frontier: the rest waits
            stack.append((depth, pairs[batch:]))
            pairs = pairs[:batch]
        if not len(pairs):
            continue
        a0, a1, b0, b1, spent = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        whole = (spent + (BITS - depth) <= budget) & ~single
        if single.any():
            x, y = a0[single], b0[single]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            forest.union(x[near], y[near])
        for p in np.flatnonzero(whole):
            members = np.r_[a0[p] : a1[p], b0[p] : b1[p]]
            forest.union(members[1:], np.full(len(members) - 1, members[0]))
        # pairs of nodes that are one component already link nothing new
        part = forest.up
        changes = np.append(0, np.cumsum(part[1:] != part[:-1]))
        one = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (part[a0] == part[b0])
        go = ~(single | whole | one)
        if not go.any():
            continue
        a0, a1, b0, b1, spent = (x[go] for x in (a0, a1, b0, b1, spent))
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        am, bm = _halves(keys, a0, a1, bit, depth), _halves(keys, b0, b1, bit, depth)
        own = (a0 == b0) & (a1 == b1)
        parts = []
        for x0, x1, y0, y1, more, extra in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~own)):
            keep = (x1 > x0) & (y1 > y0) & (spent + more <= budget)
            if extra is not None:
                keep &= extra
            keep &= ~((x0 == y0) & (x1 - x0 == 1) & (y1 - y0 == 1))
            parts.append(np.stack([x0[keep], x1[keep], y0[keep], y1[keep], spent[keep] + more], 1))
        stack.append((depth + 1, np.concatenate(parts)))
    return forest.up


def _halves(keys, lo, hi, bit, depth):
    """Where the second child of each node begins."""
    prefix = keys[lo] & ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.zeros(len(lo), np.uint64)
    return np.clip(np.searchsorted(keys, prefix | bit), lo, hi)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def _starts(budget: int) -> list[int]:
    return [BITS * i // (budget + 1) for i in range(budget + 1)] + [BITS]


def _joined(budget: int, most: int = 1 << 20):
    """Components of each unit's subtrees; block values are gathered until they have ``most`` rows, so that a task holds no more than these and one value."""
    starts = _starts(budget)

    def run(batches):
        at, held = None, []

        def close():
            fps = np.unique(np.concatenate(held))
            bits = starts[at[0] + 1] - starts[at[0]]
            turned = np.sort(_rotate(fps, starts[at[0]]))
            block = turned >> np.uint64(BITS - bits)
            nodes = np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1)
            up = trie_components(turned, budget, nodes, bits)
            differ = np.flatnonzero(up != np.arange(len(up)))
            back = _rotate(turned, BITS - starts[at[0]]) if starts[at[0]] else turned
            return pa.RecordBatch.from_arrays([pa.array(back[differ].view(np.int64)), pa.array(back[up[differ]].view(np.int64))], names=["a", "b"])

        last, rows = None, 0
        for batch in batches:
            turn, i, j, value = (batch.column(k).to_numpy() for k in range(4))
            fps = batch.column(4).to_numpy().view(np.uint64)
            for lo, hi in _runs(turn, i, j):
                key = (int(turn[lo]), int(i[lo]), int(j[lo]))
                while lo < hi:
                    if held and (key != at or (rows >= most and value[lo] != last)):
                        yield close()
                        held, rows = [], 0
                    at, end = key, hi
                    if rows + hi - lo > most:  # the values that are still begun go in, the rest waits
                        cut = lo + max(0, most - rows)
                        more = np.flatnonzero(value[cut:hi] != (value[cut - 1] if cut > lo else last if held else value[lo]))
                        end = cut + int(more[0]) if len(more) else hi
                        end = max(end, lo + 1)
                    held.append(fps[lo:end])
                    rows += end - lo
                    last, lo = value[end - 1], end
        if held:
            yield close()

    return run


def _runs(turn, i, j):
    """Stretches of rows of one kind ``(turn, i, j)``; the subtrees of its block values are joined at one go."""
    if len(turn):
        cuts = np.flatnonzero((turn[1:] != turn[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(turn)], strict=True)


def trie_links(fps: DataFrame, budget: int, max_group: int = 20_000) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fps(fp)`` as their links of at most ``budget`` bits do.

    Fingerprints that agree on a block go to one task. A block value with more
    than ``max_group`` fingerprints is cut in slices, and each pair of slices is
    a unit of its own; a task holds two slices, or as many whole block values as
    make a million fingerprints.
    """
    starts = _starts(budget)
    block = [F.shiftrightunsigned(F.shiftleft("fp", starts[i]), BITS - (starts[i + 1] - starts[i])).alias("v") for i in range(budget + 1)]
    sides = fps.select("fp", F.posexplode(F.array(*block)).alias("turn", "v"))
    sizes = sides.groupBy("turn", "v").agg(F.count("*").alias("n")).where("n > 1")
    units = sides.join(sizes, ["turn", "v"]).withColumn("m", F.ceil(F.col("n") / max_group).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    units = units.where("m = 1 or own <> other").select(F.col("turn").cast("long").alias("turn"), F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), F.col("v").cast("long").alias("v"), "fp")
    keys = ["turn", "i", "j", "v"]
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(_joined(budget)), "a long, b long")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = 5, budget: int = 6) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint, component_id, kept``.

    Words are what stands between ASCII white space, A-Z lower-cased. Texts of
    fewer than ``shingle`` words have one shingle, the whole sequence; null and
    empty texts have fingerprint zero and link like any other. Documents link at
    ``budget`` or fewer differing bits; ``component_id`` is the smallest
    identifier reachable. Null identifiers keep their row and never name a
    component unless nothing else is there. Repeated rows are rows of one
    component, and ``kept`` marks each row that bears its component's name.
    An empty table gives an empty result; further columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    marked = materialize(source.mapInArrow(releasing(_fingerprints(shingle)), "doc_id long, fp long"), "simhash-fp")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "simhash-nodes")
    parts = connected_components(trie_links(nodes.select("fp"), budget)).withColumnRenamed("node", "fp")
    named = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = named.join(names, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
