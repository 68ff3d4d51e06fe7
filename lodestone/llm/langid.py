"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``order``, with the counts of
what followed. A byte costs what PPM (method C, with exclusions) takes to code
it under the frozen counts: the probability in the longest known context, or
that of escaping to the next shorter one. As the counts are frozen, the cost of
each byte in each context is a constant, so all trees become one table and a
text is scored by look-ups alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, releasing
from .sampling import draw, labelled_sample

UNDETERMINED = "und"

#: Rows and bytes of texts that a worker scores at once, but for a longer text, and bytes that it looks up at once, of whatever text.
MOST_ROWS, MOST_BYTES, CHUNK = 2000, 1 << 20, 1 << 18


@dataclass
class PPMModel:
    """``symbol``: byte to symbol, 0 for bytes never seen. ``state``: the last ``order`` symbols to the longest known context. ``bits``: cost by context, symbol and language."""

    languages: list[str]
    order: int
    n_symbols: int
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    @staticmethod
    def fit(texts_by_language: dict[str, list[bytes]], order: int = 3, least: int = 2, most_bytes: int = 256 << 20) -> PPMModel:
        """``least``: contexts seen less often are not kept; it rises until the table of contexts, symbols and languages has ``most_bytes`` at most."""
        languages = sorted(texts_by_language)
        seen = np.zeros(256, bool)
        for texts in texts_by_language.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        symbol = np.zeros(256, np.int64)
        symbol[seen] = np.arange(1, seen.sum() + 1)
        n = int(seen.sum()) + 1
        # counts[language][k]: (context id, symbol) -> count, a context id is in base n
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for language in languages:
            grams: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
            for t in texts_by_language[language]:
                s = symbol[np.frombuffer(t, np.uint8)]
                code = s.copy()
                for k in range(order + 1):
                    if len(s) <= k:
                        break
                    if k:
                        code = code[:-1] * n + s[k:]
                    grams[k].append(code)
            counts.append([np.unique(np.concatenate(g), return_counts=True) if g else (np.empty(0, np.int64), np.empty(0, np.int64)) for g in grams])
        totals = []  # of each order: contexts and, by language, how often they were seen
        for k in range(1, order + 1):
            found = [np.unique(c[k][0] // n, return_inverse=True) for c in counts]
            totals.append([(ids, np.bincount(where, c[k][1], len(ids)) if len(ids) else np.empty(0)) for (ids, where), c in zip(found, counts, strict=True)])
        while True:
            # contexts of each order that any language keeps
            contexts = [np.zeros(1, np.int64)]
            contexts += [np.unique(np.concatenate([ids[total >= least] for ids, total in by])) if by else np.empty(0, np.int64) for by in totals]
            if 4 * sum(map(len, contexts)) * n * len(languages) <= most_bytes or sum(map(len, contexts)) == 1:
                break
            least *= 2
        base = np.cumsum([0, *(len(c) for c in contexts)])
        bits = np.empty((base[-1], n, len(languages)), np.float32)
        for j, c in enumerate(counts):
            dense = []
            for k in range(order + 1):
                d = np.zeros((len(contexts[k]), n))
                ids, sym = c[k][0] // n, c[k][0] % n
                if len(ids):
                    at = np.searchsorted(contexts[k], ids)
                    at[at == len(contexts[k])] = 0
                    there = contexts[k][at] == ids if len(contexts[k]) else np.zeros(len(ids), bool)
                    d[at[there], sym[there]] = c[k][1][there]
                if k:
                    d[d.sum(1) < least] = 0
                dense.append(d)
            for k in range(order + 1):
                bits[base[k] : base[k + 1], :, j] = _code_lengths(contexts, dense, k, n)
        shape = n**order
        state = np.zeros(shape, np.int32)
        every = np.arange(shape, dtype=np.int64)
        for k in range(1, order + 1):
            if len(contexts[k]):
                tail = every % n**k
                at = np.minimum(np.searchsorted(contexts[k], tail), len(contexts[k]) - 1)
                there = contexts[k][at] == tail
                state[there] = base[k] + at[there]
        return PPMModel(languages, order, n, symbol.astype(np.int32), state, bits.reshape(-1, len(languages)))

    def code_lengths(self, data: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Bits of each text under each language; the texts lie one after the other in ``data``. At most ``chunk`` bytes are looked up at once, so a longer text is taken in stretches."""
        ends = np.append(starts[1:], len(data))
        out = np.zeros((len(starts), len(self.languages)))
        n, order = self.n_symbols, self.order
        first = 0
        while first < len(starts):
            last = max(int(np.searchsorted(starts, starts[first] + chunk, "right")) - 1, first + 1)
            lo, hi = int(starts[first]), int(ends[last - 1])
            rows = np.flatnonzero(ends[first:last] > starts[first:last]) + first
            for at in range(lo, hi, chunk):  # once, unless it is one long text
                back = min(order, at - lo)
                s = self.symbol[data[at - back : min(at + chunk, hi)]]
                context = np.zeros(len(s), np.int32)
                begin = starts[rows] - lo if at == lo else np.zeros(1, np.int64)
                for k in range(order, 0, -1):
                    context *= n
                    context[k:] += s[:-k] if k < len(s) else 0
                if at == lo:
                    for k in range(order):  # what lies before a text isn't context
                        early = begin + k
                        early = early[early < len(s)]
                        context[early] %= n**k
                cost = self.bits.take(self.state.take(context[back:]).astype(np.int64) * n + s[back:], axis=0)
                out[rows] += np.add.reduceat(cost, begin, axis=0, dtype=np.float64)
            first = last
        return out


def _code_lengths(contexts, dense, k: int, n: int) -> np.ndarray:
    """Bits of each symbol in each context of order ``k``."""
    ids = contexts[k]
    p = np.zeros((len(ids), n))
    escape = np.ones((len(ids), 1))
    excluded = np.zeros((len(ids), n), bool)
    for j in range(k, -1, -1):
        tail = ids % n**j
        at = np.minimum(np.searchsorted(contexts[j], tail), len(contexts[j]) - 1)
        there = contexts[j][at] == tail
        c = np.where(there[:, None], dense[j][at], 0)
        c[excluded] = 0
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        p += escape * c / whole
        escape = np.where(kinds > 0, escape * kinds / whole, escape)
        excluded |= c > 0
    rest = 256 - excluded.sum(1, keepdims=True)
    p[~excluded] = np.broadcast_to(escape / np.maximum(rest, 1), p.shape)[~excluded]
    return -np.log2(p)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all lower-cased texts, and where each begins."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets[:-1] - offsets[0]).astype(np.int64)


def _parts(batch: pa.RecordBatch, column: int):
    """``batch`` in slices of at most ``MOST_ROWS`` rows and ``MOST_BYTES`` of the texts of ``column``, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + MOST_ROWS, int(np.searchsorted(ends, before + MOST_BYTES, "right"))))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def fit_language_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, per_language: int = 300, max_bytes: int = 20_000, order: int = 3) -> PPMModel | None:
    """Fit on at most ``per_language`` labelled texts of at most ``max_bytes`` bytes for each language; None without any."""
    by: dict[str, list[bytes]] = {}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("label"), F.col(text).alias("text"), F.octet_length(text).alias("size"), draw(doc_id, text).alias("draw"))
    for row in labelled_sample(rows, per_language, max_bytes):
        by.setdefault(row["label"], []).append(row["text"].lower().encode())
    return PPMModel.fit(by, order) if by else None


def identify_language(docs: DataFrame, model: PPMModel | None, doc_id: str = "doc_id", text: str = "text", *, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: ``doc_id, lang_pred, score, bits_per_byte``, and the columns to ``carry`` along.

    ``lang_pred`` is the language with the shortest code, the first by name if
    several are equal; ``score`` is its share among the languages, each weighted
    by two to the power of minus its code length. Null and empty texts, texts
    without a letter, and every text when there is no model, are ``und`` with
    score 0. Whole texts are scored, of any length. Repeated rows and null
    identifiers are rows like any other; an empty table gives an empty result;
    further columns, with whatever names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``most_bytes``

    def run(batches):
        m = shared.value
        for batch in (part for b in batches for part in _parts(b, 1)):
            ids, column = batch.column(0), batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score, rate = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            if m is not None:
                data, starts = lowered(column)
                bits = m.code_lengths(data, starts)
                best = bits.argmin(1)
                least = bits.min(1)
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                rate = least / np.maximum(np.diff(np.append(starts, len(data))), 1)
            known = lettered & (m is not None)
            names = np.array([*(m.languages if m else []), UNDETERMINED], object)
            pred = names[np.where(known, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, rate, 0.0)), *batch.columns[2:]], names=["doc_id", "lang_pred", "score", "bits_per_byte", *carry])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return source.mapInArrow(releasing(run), "doc_id long, lang_pred string, score double, bits_per_byte double" + kinds)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, and predict for all: ``doc_id, held_out, lang_pred, score, bits_per_byte``."""
    found = identify_language(docs, fit_language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
