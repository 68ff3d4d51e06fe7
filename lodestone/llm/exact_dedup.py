"""Exact deduplication with Patricia tries whose terminals own their copies.

Pass 1 runs where the text is read: every input partition inserts its full byte
strings into radix tries, one for each magnitude of lengths, where equal strings
end in one terminal and others part at the first byte that differs. When the
tries outgrow ``budget`` bytes their largest subtrees are spilled, until half of
it is free: their terminals leave as rows, and the subtrees are dropped. A third
of all rows in one group thus becomes one row for each partition before anything
is shuffled. Pass 2 deals the terminals' texts by length and two bytes of their
hash, and inserts them again, sorted: what lies before the string at hand is
complete and may be dropped at any time, so no trie has to be held whole.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing

LOCAL = "doc_id long, owner long, carrier boolean, text_sha256 string, n_bytes long, lowest long, highest long, copies long, body binary, bucket string"
OWNERS = "owner long, keep_owner long, keep_id long, smallest_id long, group_size long"


class Terminal:
    """The end of one byte string: the smallest and largest identifier of its copies, how many there are, and whatever its user keeps with it."""

    __slots__ = ("carrier", "copies", "highest", "lowest", "order", "rows", "tag")

    def __init__(self, order: int) -> None:
        self.order, self.lowest, self.highest, self.carrier, self.copies, self.tag, self.rows = order, None, None, None, 0, None, []

    def add(self, lowest, highest, carrier, copies: int = 1) -> None:
        self.copies += copies
        if lowest is not None and (self.lowest is None or lowest < self.lowest):
            self.lowest = lowest
        if self.carrier is None or (highest is not None and (self.highest is None or highest > self.highest)):
            self.highest, self.carrier = highest, carrier


#: Stands for the first byte of the empty string.
NOTHING = -1


class PatriciaTrie:
    """Compressed radix trie over byte strings; an edge carries as many bytes as it can.

    ``held`` has about how many bytes the subtree of each first byte holds.
    """

    def __init__(self) -> None:
        self.root: dict[int, list] = {}  # first byte -> [label, children, terminal]
        self.empty: Terminal | None = None
        self.size = 0
        self.held: Counter = Counter()

    def insert(self, key: bytes, cost: int = 0) -> tuple[Terminal, bool]:
        """The terminal of ``key``, and whether it is new; ``cost`` is added to what its subtree holds, and a new key's length too."""
        terminal, new = self._insert(key)
        self.held[key[0] if key else NOTHING] += cost + (200 + len(key) if new else 0)
        return terminal, new

    def _insert(self, key: bytes) -> tuple[Terminal, bool]:
        if not key:
            new = self.empty is None
            if new:
                self.empty = Terminal(self.size)
                self.size += 1
            return self.empty, new
        at, children = 0, self.root
        while True:
            node = children.get(key[at])
            if node is None:
                children[key[at]] = node = [key[at:], {}, None]
                break
            label = node[0]
            if key.startswith(label, at):
                at += len(label)
                if at == len(key):
                    break
                children = node[1]
                continue
            shared = len(os.path.commonprefix((label, key[at : at + len(label)])))
            lower = [label[shared:], node[1], node[2]]
            node[0], node[1], node[2] = label[:shared], {lower[0][0]: lower}, None
            at += shared
            if at < len(key):
                tail = [key[at:], {}, None]
                node[1][key[at]] = tail
                node = tail
            break
        if node[2] is None:
            node[2] = Terminal(self.size)
            self.size += 1
            return node[2], True
        return node[2], False

    def take(self, first: int) -> Iterator[tuple[bytes, Terminal]]:
        """Remove the subtree of a first byte; its strings, put together again from the edges, and their terminals."""
        self.held.pop(first, None)
        if first == NOTHING:
            terminal, self.empty = self.empty, None
            if terminal is not None:
                yield b"", terminal
            return
        stack = [(b"", self.root.pop(first))] if first in self.root else []
        while stack:
            above, (label, children, terminal) = stack.pop()
            key = above + label
            if terminal is not None:
                yield key, terminal
            stack.extend((key, child) for child in children.values())


def content_hash(body: bytes) -> str:
    """Two bytes of a text's hash, which with its length say where it is dealt."""
    return hashlib.sha256(body).hexdigest()[:4]


class Tries:
    """Tries by the magnitude of their strings' lengths, within a budget of bytes."""

    def __init__(self, budget: int) -> None:
        self.tries: dict[int, PatriciaTrie] = {}
        self.budget, self.held = budget, 0

    def insert(self, key: bytes, cost: int) -> Terminal:
        trie = self.tries.setdefault(len(key).bit_length(), PatriciaTrie())
        terminal, new = trie.insert(key, cost)
        self.held += cost + (200 + len(key) if new else 0)
        return terminal

    def spill(self, all_of_it: bool = False) -> Iterator[tuple[bytes, Terminal]]:
        """The strings of the largest subtrees, until half of the budget is free, or of all; they are dropped."""
        sizes = sorted(((n, magnitude, first) for magnitude, trie in self.tries.items() for first, n in trie.held.items()), reverse=True)
        for n, magnitude, first in sizes:
            if not all_of_it and self.held <= self.budget // 2:
                break
            self.held -= n
            yield from self.tries[magnitude].take(first)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)


LOCAL_ARROW = pa.schema([("doc_id", pa.int64()), ("owner", pa.int64()), ("carrier", pa.bool_()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("lowest", pa.int64()), ("highest", pa.int64()), ("copies", pa.int64()), ("body", pa.binary()), ("bucket", pa.string())])
#: Bytes of texts, about, that one batch of spilled rows has.
BATCH_BYTES = 4 << 20


def _local(budget: int, hashed):
    def run(batches):
        ordinal = (TaskContext.get().partitionId()) << 36
        tries = Tries(budget)

        def spill(all_of_it: bool = False):
            nonlocal ordinal
            out, size = [], 0
            for body, terminal in tries.spill(all_of_it):
                sha, own = hashlib.sha256(body).hexdigest(), (terminal.lowest, terminal.highest, terminal.copies, body, hashed(body))
                for i, doc_id in enumerate(terminal.rows):
                    out.append((doc_id, ordinal, terminal.carrier == i, sha, len(body), *(own if i == 0 else (None,) * 5)))
                ordinal += 1
                size += len(body) + 200 * len(terminal.rows)
                if size >= BATCH_BYTES:
                    yield _columns(out, LOCAL_ARROW)
                    out, size = [], 0
            yield _columns(out, LOCAL_ARROW)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terminal = tries.insert(body.as_py().lower(), 64)  # of bytes: A-Z only
                terminal.add(doc_id, doc_id, len(terminal.rows))
                terminal.rows.append(doc_id)
                if tries.held > budget:
                    yield from spill()
        yield from spill(True)

    return run


def _survivors_local(budget: int, kinds: pa.Schema):
    """Of every text one row of the partition: that with the greatest sort identifier. Columns: length, two bytes of the hash, the hash, identifier, then the row's own."""

    def run(batches):
        tries = Tries(budget)

        def spill(all_of_it: bool = False):
            out, size = [], 0
            for body, terminal in tries.spill(all_of_it):
                sha = hashlib.sha256(body).digest()
                out.append((len(body), sha[:2], sha, terminal.highest, *terminal.carrier))
                size += len(body) + 200
                if size >= BATCH_BYTES:
                    yield _columns(out, kinds)
                    out, size = [], 0
            yield _columns(out, kinds)

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            for doc_id, body, row in zip(batch.column(0).to_pylist(), batch.column(1), rows, strict=True):
                body = body.as_py().lower()
                terminal = tries.insert(body, 0)
                if not terminal.copies:  # its row is held beside its edges
                    extra = 300 + len(body)
                    tries.tries[len(body).bit_length()].held[body[0] if body else NOTHING] += extra
                    tries.held += extra
                terminal.add(doc_id, doc_id, row)
                if tries.held > budget:
                    yield from spill()
        yield from spill(True)

    return run


def _survivors(text_at: int, kinds: pa.Schema, budget: int):
    """Of rows in the order of length and hash, one of each text; at another hash all strings so far are complete."""

    def run(batches):
        trie, at, last, members, held, out = PatriciaTrie(), None, None, [], 0, []
        for batch in batches:
            for n, bucket, sha, doc_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n, bucket) != at or (sha != last and held > budget):
                    out += [t.carrier for t in members]
                    trie, at, members, held = PatriciaTrie(), (n, bucket), [], 0
                last = sha
                terminal, new = trie.insert((row[text_at] or "").encode().lower())
                terminal.add(doc_id, doc_id, tuple(row))
                if new:
                    members.append(terminal)
                    held += 300 + 2 * n
                if len(out) >= 256:
                    yield _columns(out, kinds)
                    out = []
        out += [t.carrier for t in members]
        yield _columns(out, kinds)

    return run


def exact_survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, budget: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the row with the largest identifier.

    Equality and ties are those of ``exact_dedup``; of rows that repeat the
    identifier that stays, one stays. Each partition gives up its own copies
    first, so a group that holds a third of all rows is a row for each partition
    when texts are dealt out, once. Null texts count as empty, texts may have any
    length, an empty table gives an empty result, and column names may be any.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(docs.columns)]
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), *own)
    named = source.select(*[f"own_{k}" for k in range(len(own))])
    kinds = to_arrow_schema(named.schema)
    head = pa.schema([("n_bytes", pa.int64()), ("bucket", pa.binary()), ("sha", pa.binary()), ("id", pa.int64())])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    ends = source.mapInArrow(releasing(_survivors_local(budget, pa.schema([*head, *kinds]))), f"n_bytes long, bucket binary, sha binary, id long, {fields}")
    dealt = ends.repartition("n_bytes", "bucket").sortWithinPartitions("n_bytes", "bucket", "sha")
    out = dealt.mapInArrow(releasing(_survivors(docs.columns.index(text), kinds, budget)), fields)
    return out.toDF(*docs.columns)


def _owners(budget: int):
    """Of texts in the order of length, two bytes of the hash and bytes, the owner of each and what its copies have in common."""
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in OWNERS.split(", ")])

    def run(batches):
        trie, at, members, held = PatriciaTrie(), None, [], 0
        out: list[tuple] = []

        def close():
            out.extend((owner, t.carrier, t.highest, t.lowest, t.copies) for owner, t in members)
            members.clear()

        for batch in batches:
            for owner, bucket, lowest, highest, copies, body in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                body = body.as_py()
                if (len(body), bucket) != at:
                    close()
                    trie, at, held = PatriciaTrie(), (len(body), bucket), 0
                terminal, new = trie.insert(body)
                if new:
                    if held > budget:  # sorted: nothing that comes can be equal to what was
                        close()
                        trie, held = PatriciaTrie(), 0
                        terminal, _ = trie.insert(body)
                    held += 200 + len(body)
                terminal.add(lowest, highest, owner, copies)
                members.append((owner, terminal))
            if len(out) > 10_000:
                yield _columns(out, kinds)
                out.clear()
        close()
        yield _columns(out, kinds)

    return run


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, keep: str = "largest", budget: int = 32 << 20, hashed=content_hash) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes``.

    Texts are equal when they are identical after lower-casing A-Z. ``keep`` is
    ``largest`` or ``smallest``: which identifier of a group stays.
    Null texts count as empty; empty texts equal each other. A null identifier
    is smaller than any other for ``largest`` and is never taken by ``smallest``
    while another is there. Rows that repeat the identifier that stays: one of
    them stays. Texts may have any length. An empty table gives an empty result;
    further columns, with whatever names, are ignored. ``hashed`` gives the part
    of the hash that texts are dealt by; whatever it is, the tries tell texts apart.
    """
    sign = F.lit(1 if keep == "largest" else -1)
    source = docs.select((F.col(doc_id).cast("long") * sign).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    local = materialize(source.mapInArrow(releasing(_local(budget, hashed)), LOCAL), "exact-local")
    ends = local.where("body is not null").select("owner", "bucket", "lowest", "highest", "copies", "body", "n_bytes")
    ends = ends.repartition("n_bytes", "bucket")
    owners = ends.sortWithinPartitions("n_bytes", "bucket", "body").drop("n_bytes").mapInArrow(releasing(_owners(budget)), OWNERS)
    found = local.select("doc_id", "owner", "carrier", "text_sha256", "n_bytes").join(owners, "owner")
    return found.select(
        (F.col("doc_id") * sign).alias("doc_id"),
        (F.col("keep_id") * sign).alias("keep_id"),
        F.col("group_size"),
        (F.col("carrier") & (F.col("owner") == F.col("keep_owner"))).alias("kept"),
        "text_sha256",
        "n_bytes",
    )
