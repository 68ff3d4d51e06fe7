"""Best-fit packing of documents into sequences, by bin completion with branch and bound.

How pieces are packed depends only on how many there are of each length, and
there are at most ``capacity`` lengths however large the corpus is. So the
lengths are counted on the executors, the search runs over these counts, and its
answer, a list of fillings with how often each is used, is dealt out again by
numbering the pieces of each length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialize, releasing

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
#: Settings of a vocabulary whose words can be encoded one by one (fixed values): how it splits, and how a word ends.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The same split, for lower-cased texts of the characters of PLAIN alone; all other texts go through the tokenizer whole.
PIECE_OF_CHUNK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
PLAIN = b"\t\n\r" + bytes(range(0x20, 0x7F)) + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])).encode("latin-1")
MOST_CACHED = 500_000


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def _word_by_word(settings: dict) -> bool:
    """Whether a tokenizer's own settings are those that the short way below stands for."""
    normal = settings.get("normalizer") or {}
    split = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model = settings.get("model") or {}
    return (
        [n.get("type") for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and split.get("pattern") == {"Regex": WORD_SPLIT}
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == WORD_END
        and not model.get("dropout")
        and array("I").itemsize == 4
        and sys.byteorder == "little"
        and all("<|" in x["content"] for x in settings.get("added_tokens") or [])
    )


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a bounded memory of chunks between white space.

    Where the vocabulary's settings allow, the words of a chunk that is met for
    the first time go to the vocabulary's model one by one, their letters turned
    into those that the vocabulary's own pre-tokenizer writes for their bytes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.short = _word_by_word(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.chunks = Chunks(self._chunk)
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {x: written.pre_tokenize_str(chr(x))[0][0] for x in range(0xC0, 0x100)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return self._word(chunk) if chunk.isalpha() else b"".join(map(self._word, PIECE_OF_CHUNK.findall(chunk)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [t.lower().split() if self.short and _is_plain(t) else None for t in texts]
        if len(self.chunks) > MOST_CACHED:  # the younger half stays
            self.chunks = Chunks(self._chunk, islice(self.chunks.items(), len(self.chunks) // 2, None))
        rest = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if p is None]))
        get = self.chunks.__getitem__
        return [next(rest) if p is None else b"".join(map(get, p)) for p in plain]


class Chunks(dict):
    """What stands between white space, to its ids; looked up where it is missing."""

    def __init__(self, make, items=()) -> None:
        super().__init__(items)
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = made = self.make(chunk)
        return made


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_pieces(docs: DataFrame, doc_id: str, text: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece: ``doc_id, row, piece, start, length, ids_crc32``. ``row`` tells rows of one identifier apart within their task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = kept(vocabulary, lambda: Encoder(vocabulary))
        row = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    raw = ids + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        some = raw[at : at + 4 * capacity]
                        out.append((doc_id, row, k, at // 4, len(some) // 4, zlib.crc32(some)))
                    row += 1
                columns = list(zip(*out, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(releasing(run, keeps=vocabulary), PIECES)


# ---- the search over counts of lengths ----


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound, the greatest over all cuts: pieces over half a bin need one each, and what is small and at least the cut must go beside them or into bins of its own."""
    if not counts:
        return 0
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    size = np.arange(capacity + 1)
    number, load = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * size))  # of pieces below a length
    half = capacity // 2
    cut = np.arange(half + 1)
    n_big = number[-1] - number[half + 1]
    beside = capacity - cut  # large pieces up to this length have room for a piece of the cut's length
    middle, middle_load = number[beside + 1] - number[half + 1], load[beside + 1] - load[half + 1]
    small = load[half + 1] - load[cut]
    more = np.maximum(0, -(-(small - (middle * capacity - middle_load)) // capacity))
    return int(max((n_big + more).max(), -(-load[-1] // capacity)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: fillings ``(times, lengths)``; bins in the same state move together."""
    open_bins: dict[int, list] = {}  # free room -> [(times, lengths)]
    rooms: list[int] = []
    done = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            at = rooms[k] if k < len(rooms) else None
            if at is None:
                fit = capacity // length
                times, rest = divmod(left, fit)
                if times:
                    _open(open_bins, rooms, done, capacity - fit * length, times, (length,) * fit)
                if rest:
                    _open(open_bins, rooms, done, capacity - rest * length, 1, (length,) * rest)
                left = 0
                continue
            times, filling = open_bins[at].pop()
            if not open_bins[at]:
                del open_bins[at]
                rooms.remove(at)
            fit = min(at // length, left)
            use = min(times, left // fit)
            if use < times:
                _open(open_bins, rooms, done, at, times - use, filling)
            _open(open_bins, rooms, done, at - fit * length, use, filling + (length,) * fit)
            left -= use * fit
    for group in open_bins.values():
        done.extend(group)
    return done


def _open(open_bins, rooms, done, room, times, filling):
    if not room:
        done.append((times, filling))
        return
    if room not in open_bins:
        open_bins[room] = []
        rooms.insert(bisect_right(rooms, room), room)
    open_bins[room].append((times, filling))


def completions(lengths: list[int], counts: dict[int, int], room: int, most: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated ways to fill ``room``, fullest first, and whether these are all.

    A filling is dominated if one of its pieces, or a pair, can be replaced by
    a single longer piece that still fits: what is replaced is easier to place
    later. A single piece that leaves no room dominates everything else. Past
    ``16 * most`` fillings the search for more ends; then those without waste
    are looked up, and ``most`` are given. ``lengths`` falls.
    """
    if room == 0:
        return [()], True
    if counts.get(room, 0) > 0:
        return [(room,)], True
    found: list[tuple[int, ...]] = []
    steps, limit = 0, 16 * most

    def extend(at: int, left: int, chosen: tuple[int, ...]) -> bool:
        nonlocal steps
        fits = False
        for k in range(at, len(lengths)):
            n = lengths[k]
            steps += 1
            if n <= left and counts[n] > chosen.count(n):
                fits = True
                if not extend(k, left - n, (*chosen, n)):
                    return False
        if not fits and not any(n <= left and counts[n] > chosen.count(n) for n in lengths[:at]):  # else another filling has it all and more
            found.append(chosen)
        return len(found) < limit and steps < 16 * limit

    whole = extend(0, room, ())
    if not whole:
        found = _exact(lengths, counts, room, most) + found
    rising = lengths[::-1]
    kept = [f for f in dict.fromkeys(found) if not _dominated(f, room - sum(f), rising, counts)]
    kept.sort(key=lambda f: (-sum(f), len(f), tuple(-n for n in f)))
    return (kept, True) if whole else ((kept or [()])[:most], False)


def _exact(lengths: list[int], counts: dict[int, int], room: int, most: int) -> list[tuple[int, ...]]:
    """Fillings without waste, of two or three pieces, longest pieces first; not all of them."""

    def pairs(space: int, ceiling: int, used: int | None):
        for n in lengths:
            rest = space - n
            if n > ceiling or rest > n or rest <= 0:
                if rest > n:
                    return
                continue
            need = (n == rest) + 1
            if counts[n] - (n == used) >= need and counts.get(rest, 0) - (rest == used) >= 1:
                yield n, rest

    out = list(islice(pairs(room, room, None), most))
    if out:
        return out
    for n in [n for n in lengths if n < room and counts[n] > 0][:8]:
        out.extend((n, *p) for p in islice(pairs(room - n, n, n), most - len(out)))
        if len(out) >= most:
            break
    return out


def _dominated(filling: tuple[int, ...], waste: int, rising: list[int], counts: dict[int, int]) -> bool:
    """``rising``: the lengths in rising order."""

    def spare(lo: int, hi: int) -> bool:
        k = bisect_left(rising, lo)
        while k < len(rising) and rising[k] <= hi:
            if counts[rising[k]] > filling.count(rising[k]):
                return True
            k += 1
        return False

    for i, n in enumerate(filling):
        if waste and spare(n + 1, n + waste):
            return True
        if any(spare(n + k, n + k + waste) for k in filling[i + 1 :]):
            return True
    return False


def bin_completion(counts: dict[int, int], capacity: int, *, nodes: int = 4_000, width: int = 8) -> tuple[list[tuple[int, tuple[int, ...]]], int, bool]:
    """Fillings ``(times, lengths)``, the lower bound, and whether the number of bins is proven to be the least.

    The first incumbent is best-fit decreasing. If it doesn't meet the lower
    bound, the search fills the bin of the largest piece in every undominated
    way, fullest first, and leaves a branch when the bins used plus the bound of
    the rest reach the incumbent; branches are tried with best fit for the rest
    as the next incumbent. A filling is used as often as its pieces last, and in
    a further branch once. ``nodes`` and ``width`` bound the search to seconds,
    never what is packed. A result counts as proven if it meets the bound, or if the search
    ended by itself and no enumeration was cut short.
    """
    counts = {n: c for n, c in counts.items() if c}
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(t for t, _ in incumbent)
    spent, complete = 0, True
    seen: set[tuple] = set()
    stack: list[tuple[dict[int, int], tuple | None, int, int]] = [(counts, None, 0, 0)]
    while stack and best > bound and spent < nodes:
        left, path, used, depth = stack.pop()
        spent += 1 + len(left) // 512  # of many lengths a node takes longer
        if not left or used + lower_bound(left, capacity) >= best:
            if not left and used < best:
                best, incumbent = used, _steps(path)
            continue
        if len(left) <= 64:  # the same rest reached with as few bins before
            state = (used, tuple(sorted(left.items())))
            if state in seen:
                continue
            seen.add(state)
        if depth % 32 == 0 or len(left) <= 64:
            rest = best_fit(left, capacity)
            if used + sum(t for t, _ in rest) < best:
                best, incumbent = used + sum(t for t, _ in rest), rest + _steps(path)
                if used + lower_bound(left, capacity) >= best:
                    continue
        lengths = sorted(left, reverse=True)
        largest = lengths[0]
        others = dict(left)
        others[largest] -= 1
        fillings, whole = completions(lengths, others, capacity - largest, width)
        complete &= whole
        branches = []
        for filling in fillings:
            full = (largest, *filling)
            most = min(left[n] // full.count(n) for n in set(full))
            for times in (most, 1) if most > 1 else (1,):
                after = dict(left)
                for n in full:
                    after[n] -= times
                    if not after[n]:
                        del after[n]
                branches.append((after, (path, (times, full)), used + times, depth + 1))
        stack.extend(reversed(branches))
    return incumbent, bound, best == bound or (complete and not stack)


def _steps(path: tuple | None) -> list:
    out = []
    while path is not None:
        path, step = path
        out.append(step)
    return out


def slots(fillings: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """For each length, runs of its pieces in order: ``(length, first piece, pieces a sequence, first sequence, offset)``."""
    out, taken, sequence = [], {}, 0
    for times, filling in fillings:
        offset = 0
        for n in sorted(set(filling), reverse=True):
            each = filling.count(n)
            out.append((n, taken.get(n, 0), each, sequence, offset))
            taken[n] = taken.get(n, 0) + each * times
            offset += each * n
        sequence += times
    return out


def best_fit_packing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, capacity: int = 4096, vocabulary: str | None = None, end_id: int = 1, per_salt: int = 100_000) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Texts become ids by ``vocabulary``, then ``end_id``. Only documents of more
    than ``capacity`` ids are cut, every ``capacity`` ids, however long they are.
    Null and empty texts have the one id ``end_id``. Every row is packed,
    repeated rows too; null identifiers are rows like any other. Pieces of one
    length are interchangeable and take their places in the order of identifier,
    piece and row. An empty table gives an empty result; further columns, with
    whatever names, are ignored. Lengths with many pieces are numbered in
    stretches of about ``per_salt``.
    """
    pieces = tokenize_pieces(docs, doc_id, text, vocabulary or default_vocabulary(), capacity, end_id)
    pieces = materialize(pieces.withColumn("hash", F.xxhash64("doc_id", "piece", "row")), "packing-pieces")
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # bounded: capacity
    hot = [x for r in lengths if r["n"] > per_salt for x in (F.lit(r["length"]), F.lit(-(-r["n"] // per_salt)))]
    pieces = pieces.withColumn("salt", F.coalesce(F.pmod("hash", F.create_map(*hot)[F.col("length")]), F.lit(0)).cast("long") if hot else F.lit(0).cast("long"))
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counted = [tuple(r) for r in sizes.collect()]  # bounded: capacity, and one for each per_salt pieces
    counts: dict[int, int] = {}
    before = {}
    for length, s, n in sorted(counted):
        before[length, s] = counts.get(length, 0)
        counts[length] = before[length, s] + n
    fillings, _, _ = bin_completion(counts, capacity)
    runs: dict[int, list] = {}
    for length, first, each, sequence, offset in slots(fillings):
        runs.setdefault(length, []).append((first, each, sequence, offset))
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast((before, {n: np.array(r, np.int64) for n, r in runs.items()}))  # bounded by the counts

    def place(batches):
        starts, by = plan.value
        for batch in batches:
            length, s, n = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "salt", "n"))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            cuts = np.flatnonzero((length[1:] != length[:-1]) | (s[1:] != s[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True):
                if hi == lo:
                    continue
                rank = n[lo:hi] - 1 + starts[int(length[lo]), int(s[lo])]
                r = by[int(length[lo])]
                k = np.searchsorted(r[:, 0], rank, "right") - 1
                inside = rank - r[k, 0]
                sequence[lo:hi] = r[k, 2] + inside // r[k, 1]
                offset[lo:hi] = r[k, 3] + inside % r[k, 1] * length[lo]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row", "ids_crc32", "start")
    numbered = pieces.withColumn("n", F.row_number().over(order).cast("long"))
    return numbered.mapInArrow(releasing(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
