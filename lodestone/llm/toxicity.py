"""Toxic spans from a linear-chain conditional random field with two tags.

Documents carry labels, tokens don't; so tokens of toxic training documents are
labelled first: a word, or a beginning of words, is offending where it is found in many different
surroundings of toxic documents and hardly anywhere in clean ones (surroundings,
as copies of one document would count many times otherwise). The field learns
from these tags, and forward-backward marginals of every token of a text give
its score and the offsets of what offends.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, releasing
from .sampling import draw, labelled_sample

TOKEN = re.compile(r"[^\W\d_]+")
SEGMENT = 64


@dataclass
class CRF:
    """``vocabulary``: word to emission, 0 for any other. ``odds``: emission odds of tag 1. ``move``: weights from tag to tag. ``document``: weights of (1, greatest marginal, log1p of their sum)."""

    vocabulary: dict[str, int]
    odds: np.ndarray
    move: np.ndarray
    document: np.ndarray

    def marginals(self, emissions: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probability of tag 1 for each token; sequences lie one after the other."""
        return marginals(self.odds[emissions], starts, ends, self.move)


#: Tokens of a sequence that are taken together; longer ones are cut, and the cuts joined through 2 x 2 products.
STRETCH = 64


def _steps(odds: np.ndarray, starts: np.ndarray, ends: np.ndarray, move: np.ndarray, left: np.ndarray | None, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the token's own) and backward odds, all sequences a step at a time, longest first; ``left`` are the odds of the token before each (NaN: none), ``right`` the backward odds that each ends with."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    lo, n = starts[order], lengths[order]
    (m00, m01), (m10, m11) = move
    forward, backward = np.array(odds), np.ones(len(odds))
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")  # sequences with a token t
    r = np.full(len(lo), np.nan) if left is None else left[order]
    for t, k in enumerate(active):
        at = lo[:k] + t
        e, before = odds[at], r[:k]
        r = e * np.where(np.isnan(before), 1.0, (m01 + m11 * before) / (m00 + m10 * before))
        forward[at] = r
    last = lo + n - 1
    r = np.ones(len(lo)) if right is None else right[order]
    if len(lo):
        backward[last] = r
    for t, k in enumerate(active[1:], 1):
        before = last[:k] - t
        x = odds[before + 1] * r[:k]
        r = (m10 + m11 * x) / (m00 + m01 * x)
        backward[before] = r
    return forward, backward


def chains(odds: np.ndarray, starts: np.ndarray, ends: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the token's own) and backward odds of all sequences.

    Sequences are cut into stretches of ``STRETCH`` tokens. The products of a
    stretch's 2 x 2 matrices say what odds go out of it for those that come in;
    with them the odds at all cuts follow stretch by stretch, and then all
    stretches are gone through together: a very long text takes as many steps
    as it has stretches, not tokens.
    """
    lengths = ends - starts
    if not len(lengths) or lengths.max() <= 2 * STRETCH:
        return _steps(odds, starts, ends, move, None, None)
    pieces = -(-lengths // STRETCH)
    first = np.cumsum(pieces) - pieces
    of = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(pieces.sum()) - first[of]
    lo = starts[of] + nth * STRETCH
    hi = np.minimum(lo + STRETCH, ends[of])
    # rows of each product are the tag before the stretch, columns the tag of its last token
    product = np.broadcast_to(np.eye(2), (len(lo), 2, 2)).copy()
    for t in range(STRETCH):
        live = np.flatnonzero(lo + t < hi)
        if not len(live):
            break
        step = np.broadcast_to(move, (len(live), 2, 2)).copy()
        step[:, :, 1] *= odds[lo[live] + t][:, None]
        made = product[live] @ step
        product[live] = made / made.max(axis=(1, 2), keepdims=True)
    left, right = np.full(len(lo), np.nan), np.ones(len(lo))
    order = np.argsort(-pieces, kind="stable")
    active = np.searchsorted(-pieces[order], -np.arange(1, pieces.max() + 1), "right")
    state = None
    for k, count in enumerate(active):
        at = first[order[:count]] + k
        if k:
            left[at] = state[:count, 1] / np.maximum(state[:count, 0], 1e-300)
            state = np.einsum("ni,nij->nj", state[:count], product[at])
        else:  # nothing stands before the first token: its own odds alone begin the sequence
            begin = lo[at]
            tail = _steps(odds, begin, hi[at], move, None, None)[0][hi[at] - 1]
            state = np.stack([np.ones(count), tail], 1)
        state = state / state.max(axis=1, keepdims=True)
    end = first + pieces - 1
    back = np.ones((len(lengths), 2))
    for k in range(1, pieces.max()):
        rows = np.flatnonzero(pieces > k)
        at = end[rows] - k + 1  # the stretch after the one that ends here
        back[rows] = np.einsum("nij,nj->ni", product[at], back[rows])
        back[rows] /= back[rows].max(axis=1, keepdims=True)
        right[at - 1] = back[rows, 1] / np.maximum(back[rows, 0], 1e-300)
    return _steps(odds, lo, hi, move, left, right)


def marginals(odds: np.ndarray, starts: np.ndarray, ends: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of tag 1 for each token."""
    forward, backward = chains(odds, starts, ends, move)
    both = forward * backward
    return both / (1 + both)


def pair_marginals(odds: np.ndarray, forward: np.ndarray, backward: np.ndarray, inner: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Sums over the tokens ``inner`` of the probabilities of each pair of tags of the token before and the token."""
    r, x = forward[inner - 1], odds[inner] * backward[inner]
    pairs = np.stack([np.full(len(inner), move[0, 0]), move[0, 1] * x, move[1, 0] * r, move[1, 1] * r * x])
    return (pairs / pairs.sum(0)).sum(1).reshape(2, 2)


def tokens_of(text: str) -> list[str]:
    """The lower-cased tokens of a text. Lower-casing the whole is the same, but for the one letter that becomes two."""
    return TOKEN.findall(text.lower()) if "\u0130" not in text else [w.lower() for w in TOKEN.findall(text)]


#: Lengths of the word beginnings that may offend by themselves.
BEGINNINGS = (7, 6, 5, 4)


def label_tokens(rows: list[tuple[int, list[str]]], share: float = 0.9, evidence: float = 10.0) -> set[str]:
    """Words, and beginnings of words (written ``abcd*``), that offend.

    ``share`` of their surroundings must be toxic once each class weighs the
    same, and a likelihood-ratio test against chance must exceed ``evidence``
    plus what testing all words costs (twice the logarithm of their number).
    Beginnings must also have three words or more.
    """
    ids: dict[str, int] = {"": 0}
    tokens = [np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found)) for _, found in rows]
    if not tokens:
        return set()
    names = list(ids)
    word = np.concatenate(tokens)
    before = np.concatenate([np.append(0, t[:-1])[: len(t)] for t in tokens])
    toxic = np.repeat([y for y, _ in rows], [len(t) for t in tokens]).astype(bool)
    size = np.array([(~toxic).sum(), toxic.sum()]) + 1.0
    chance = size[1] / size.sum()
    least = evidence + 2 * np.log(len(names))
    out: set[str] = set()
    for k in (0, *BEGINNINGS):
        if k:
            units: dict[str, int] = {"": 0}
            unit = np.array([units.setdefault(w[:k] + "*" if len(w) > k else "", len(units)) for w in names])
            labels, kinds = list(units), np.bincount(unit, minlength=len(units))
        else:
            unit, labels, kinds = np.arange(len(names)), names, None
        clean, bad = (np.bincount(np.unique(unit[word[toxic == y]] * len(names) + before[toxic == y]) // len(names), minlength=len(labels)).astype(float) for y in (False, True))
        good = (bad >= 3) & (bad / size[1] >= share * (bad / size[1] + (clean + 0.5) / size[0]))
        if kinds is not None:
            good &= kinds >= 3
        good[0] = False
        t, c = bad[good], clean[good]
        ratio = 2 * (t * np.log(t / (t + c) / chance) + c * np.log(np.maximum(c, 1) / (t + c) / (1 - chance)))
        out.update(labels[i] for i in np.flatnonzero(good)[ratio >= least])
    return out


class Emissions(dict):
    """Word to emission number: its own, or that of its longest beginning that offends, or 0. Remembers a bounded number of words."""

    def __init__(self, vocabulary: dict[str, int], most: int = 500_000) -> None:
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: str) -> int:
        get = self.vocabulary.get
        found = get(word) or next((i for k in BEGINNINGS if len(word) > k and (i := get(word[:k] + "*"))), 0)
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found


def fit_crf(rows: list[tuple[int, str]], *, most_words: int = 50_000, rounds: int = 40) -> CRF:
    """Fit the field, emissions and transitions, by gradient ascent, then the weights of a document's marginals by Newton's method."""
    tokenised = [(toxic, tokens_of(text)) for toxic, text in rows]
    offending = label_tokens(tokenised)
    common = Counter(w for _, tokens in tokenised for w in tokens)
    bad = Emissions({w: 1 for w in offending})
    names = sorted(offending) + [w for w, n in sorted(common.items(), key=lambda x: (-x[1], x[0])) if n >= 5 and not bad[w]][:most_words]
    vocabulary = {w: i + 1 for i, w in enumerate(names)}
    number = Emissions(vocabulary)
    # training segments: all of the toxic documents' and as many tokens again of the clean ones
    segments, tags = [], []
    for toxic, tokens in tokenised:
        ids = np.fromiter((number[w] for w in tokens), np.int64, len(tokens))
        y = np.fromiter((toxic == 1 and bad[w] == 1 for w in tokens), bool, len(tokens))
        for at in range(0, len(tokens), SEGMENT):
            segments.append(ids[at : at + SEGMENT])
            tags.append(y[at : at + SEGMENT])
    weight, bias, move = np.zeros(len(vocabulary) + 1), -4.0, np.zeros((2, 2))
    if segments:
        x, y = np.concatenate(segments), np.concatenate(tags).astype(float)
        ends = np.cumsum([len(s) for s in segments])
        starts = ends - [len(s) for s in segments]
        inner = np.ones(len(x), bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)
        seen = np.bincount(x, minlength=len(weight)) + 1.0
        pairs = np.array([[((y[inner - 1] == a) & (y[inner] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        # the odds of the counts begin the ascent; the weights towards tag 0 stay zero, as only differences matter
        move = np.log(pairs + 0.5) - np.log(pairs[:, :1] + 0.5)
        bias = 0.0
        for k in range(rounds):
            odds = np.exp(np.clip(weight[x] + bias, -30, 30))
            forward, backward = chains(odds, starts, ends, np.exp(move))
            p = forward * backward / (1 + forward * backward)
            step = 4.0 / (1 + 0.05 * k)
            gradient = np.bincount(x, y - p, len(weight))
            expected = pair_marginals(odds, forward, backward, inner, np.exp(move))
            weight += step * (gradient - 0.01 * weight) / np.sqrt(seen)
            weight = np.clip(weight, -12, 12)
            move[:, 1] = np.clip(move[:, 1] + 0.5 * (pairs[:, 1] - expected[:, 1]) / (pairs[:, 1] + expected[:, 1] + 1), -12, 12)
            bias += 0.5 * float((y - p).mean()) / max(float(p.mean()), 1e-4)
            bias = float(np.clip(bias, -12, 12))
    weight[0] = min(weight[0], 0.0)
    crf = CRF(vocabulary, np.exp(np.clip(weight + bias, -30, 30)), np.exp(move), np.zeros(3))
    # all documents of the sample at once, as scoring does
    ids = [np.fromiter((number[w] for w in tokens), np.int64, len(tokens)) for _, tokens in tokenised]
    features, _ = _features(crf, ids)
    crf.document[:] = _logistic(features, np.array([toxic for toxic, _ in tokenised], float))
    return crf


def _features(crf: CRF, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(1, greatest marginal, log1p of their sum) of each text, and the marginals of all tokens, one text after the other."""
    n = np.array([len(t) for t in texts], np.int64)
    ids = np.concatenate(texts) if texts else np.empty(0, np.int64)
    ends = np.cumsum(n)
    starts, some = ends - n, n > 0
    p = crf.marginals(ids, starts[some], ends[some])
    features = np.zeros((len(texts), 3))
    features[:, 0] = 1
    if some.any():
        features[some, 1] = np.maximum.reduceat(p, starts[some])
        features[some, 2] = np.log1p(np.add.reduceat(p, starts[some]))
    return features, p


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(3)
    if not len(x):
        return np.array([-4.0, 0, 0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        w += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - ridge * w), -2, 2)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_label: int = 1000, max_bytes: int = 20_000) -> CRF:
    """Fit on at most ``per_label`` labelled texts of each class, of at most ``max_bytes`` bytes; held-out rows and null labels aren't used."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id", "text", F.octet_length("text").alias("size"), draw("doc_id", "text").alias("draw")).join(marked, "doc_id")
    rows = labelled_sample(known.withColumnRenamed("toxic", "label"), per_label, max_bytes)
    return fit_crf([(int(r["label"] == 1), r["text"]) for r in rows])


def score_toxicity(docs: DataFrame, crf: CRF, doc_id: str = "doc_id", text: str = "text", *, threshold: float = 0.3, span: float = 0.5) -> DataFrame:
    """One row for each input row: ``doc_id, score, predicted, n_offending, spans``.

    ``spans`` has the character offsets (start, end) of tokens whose marginal is
    ``span`` or more; neighbours are merged. Null and empty texts have no token
    and get the score of a text with no sign of anything. Whole texts are
    scored, of any length, and offsets are those of the text as it is. Repeated
    rows and null identifiers are rows like any other; an empty table gives an
    empty result; further columns, with whatever names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # bounded by the sample

    def run(batches):
        m = shared.value
        number = Emissions(m.vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            # words become numbers text by text: a batch's words at once would be many times its size
            parts = [np.array([number[w] for w in tokens_of(t)], np.int32) for t in texts]
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            features, p = _features(m, parts)
            del parts
            score = 1 / (1 + np.exp(-features @ m.document))
            spans, counts = [[] for _ in texts], np.zeros(len(texts), np.int64)
            hit = np.flatnonzero(p >= span)
            for i in np.unique(np.searchsorted(ends, hit, "right")):
                at = [x.span() for x in TOKEN.finditer(texts[i])]
                mine = hit[(hit >= starts[i]) & (hit < ends[i])] - starts[i]
                counts[i] = len(mine)
                for k in mine:
                    if spans[i] and k and spans[i][-1][1] == at[k - 1][1]:
                        spans[i][-1] = (spans[i][-1][0], at[k][1])
                    else:
                        spans[i].append(at[k])
            made = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(counts), made], names=["doc_id", "score", "predicted", "n_offending", "spans"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(releasing(run), "doc_id long, score double, predicted int, n_offending long, spans array<struct<start:long,end:long>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that aren't held out, and score all: ``doc_id, held_out, score, predicted, n_offending, spans``."""
    found = score_toxicity(docs, fit_toxicity(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_offending", "spans")
