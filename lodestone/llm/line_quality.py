"""Content and boilerplate lines by Viterbi decoding of a linear-chain conditional random field.

Documents carry a quality label, lines don't. So the field begins with every line
of a bad training document tagged as boilerplate and every line of a good one as
content, and is then fitted again on what it makes of the lines of bad ones: their
ordinary lines become content. Lines are told by how they look (length,
repetition, capitals, symbols, punctuation, copies in the same document) and by
their first and last words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, releasing
from .sampling import draw, labelled_sample
from .toxicity import chains, pair_marginals

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
#: White space for ``str.split`` that doesn't separate words here.
OTHER_SPACE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
MARK = re.compile(r"[#*$%&|<>!?{}=_~^\\»©•]")
SENTENCE_END = re.compile(r"[.!?…。]")
LINK = re.compile(r"https?:|www\.|@")
#: Buckets of the first and of the last word of a line.
HASHED = 4096
#: Sizes of the families of features; a line has one feature of each.
FAMILIES = {"words": 12, "distinct": 6, "capitals": 6, "marks": 6, "begins": 6, "ends": 6, "length": 8, "digits": 5, "copies": 3, "link": 2, "sentences": 6, "first": HASHED, "last": HASHED}
OFFSETS = dict(zip(FAMILIES, np.cumsum([0, *FAMILIES.values()])[:-1].tolist(), strict=True))
N_FEATURES = sum(FAMILIES.values())
#: Bound of the log weights between tags: a document's label holds for all of its lines at first, which alone would make every tag follow from the one before.
MOST_MOVE = 2.0
#: What is kept has this share of its words in content lines, and passes the base rules (fixed values).
CONTENT_SHARE, LEAST_WORDS, MOST_REPEATED = 0.5, 50, 50


def _share(part: int, whole: int, top: int) -> int:
    """0 for none, then more the greater the share, up to ``top``."""
    return 0 if not part else min(top, 1 + part * top // max(whole, 1))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".!?…。" else 5


@lru_cache(maxsize=100_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % HASHED


def line_features(line: str, words: list[str], copies: int) -> list[int]:
    """Feature numbers of a line that has words: one of each family."""
    n, o = len(words), OFFSETS
    chars = len("".join(words))
    values = (
        min(n.bit_length(), 11),
        min(5, len(set(words)) * 6 // (n + 1)),
        _share(sum(map(str.isupper, words)), n, 5),
        _share(len(MARK.findall(line)), n, 5),
        _kind(words[0][0]),
        _kind(words[-1][-1]),
        min(chars // n // 2, 7),
        _share(sum(map(str.isdigit, words)), n, 4),
        min(copies, 3) - 1,
        int(LINK.search(line) is not None),
        _share(4 * len(SENTENCE_END.findall(line)), n, 5),
        _bucket(words[0]),
        _bucket(words[-1]),
    )
    return [at + v for at, v in zip(o.values(), values, strict=True)]


@dataclass
class Lines:
    """The lines of a text that have words: their words, places and features; and the counts of the whole text."""

    words: list[list[str]]
    spans: list[tuple[int, int]]
    features: list[list[int]]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def n_words(self) -> int:
        return sum(map(len, self.words))


def repeated_words(lines: list[list[str]], window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first find included."""
    ids: dict[str, int] = {}
    number = ids.setdefault
    word = np.array([number(w, len(ids)) for ws in lines for w in ws], np.int32).astype(np.int64)
    if len(word) <= window:
        return 0
    key = word[: len(word) - window + 1]
    for k in range(1, window):  # numbers of the windows so far are dense again after each word, so that none overflows
        key = np.unique(key * len(ids) + word[k : len(word) - window + 1 + k], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    inside = np.zeros(len(word), bool)
    for k in range(window):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def read_lines(text: str | None) -> Lines:
    text = text or ""
    cut = WORD.findall if OTHER_SPACE.search(text) else str.split
    raw = text.split("\n")
    words, spans, kept, at = [], [], [], 0
    for line in raw:
        if found := cut(line):
            words.append(found)
            spans.append((at, at + len(line)))
            kept.append(line)
        at += len(line) + 1
    times = Counter(kept)
    features = [line_features(line, ws, times[line]) for line, ws in zip(kept, words, strict=True)]
    return Lines(words, spans, features, sum(len("".join(ws)) for ws in words), len(SYMBOL.findall(text)), len(kept) - len(times), repeated_words(words))


@dataclass
class LineField:
    """Weights towards boilerplate of every feature and of every line, and log weights from tag to tag."""

    weights: np.ndarray
    bias: float
    move: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """The likeliest tags of the lines of one text, 1 for boilerplate."""
        if not features:
            return []
        return viterbi((self.weights[np.array(features)].sum(1) + self.bias).tolist(), self.move)


def viterbi(emissions: list[float], move: np.ndarray) -> list[int]:
    """The best sequence of two tags; ``emissions`` are weights of tag 1 against tag 0. Ties go to tag 0."""
    (m00, m01), (m10, m11) = move.tolist()
    s0, s1, back = 0.0, emissions[0], []
    for e in emissions[1:]:
        from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
        back.append((from0, from1))
        s0, s1 = max(s0 + m00, s1 + m10), e + max(s0 + m01, s1 + m11)
    tag = int(s1 > s0)
    out = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        out.append(tag)
    return out[::-1]


def _ascend(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, rounds: int, ridge: float, linked: bool = True) -> LineField:
    """Emissions, and transitions if lines are ``linked``, by gradient ascent of the likelihood of tags ``y``."""
    inner = np.ones(len(x), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    flat, seen = x.ravel(), np.bincount(x.ravel(), minlength=N_FEATURES) + 1.0
    pairs = np.array([[((y[inner - 1] == a) & (y[inner] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    move = np.clip(np.log(pairs + 1) - np.log(pairs[:, :1] + 1), -MOST_MOVE, MOST_MOVE) * linked
    weights, bias, g = np.zeros(N_FEATURES), 0.0, x.shape[1]
    for k in range(rounds):
        odds = np.exp(np.clip(weights[x].sum(1) + bias, -30, 30))
        forward, backward = chains(odds, starts, ends, np.exp(move))
        p = forward * backward / (1 + forward * backward)
        step = 1.0 / (1 + 0.05 * k)
        gradient = np.bincount(flat, np.repeat(y - p, g), N_FEATURES)
        weights = np.clip(weights + step * (gradient - ridge * weights) / np.sqrt(seen * len(FAMILIES)), -8, 8)
        expected = pair_marginals(odds, forward, backward, inner, np.exp(move)) if len(inner) and linked else pairs
        move[:, 1] = np.clip(move[:, 1] + 0.3 * (pairs[:, 1] - expected[:, 1]) / (pairs[:, 1] + expected[:, 1] + 1), -MOST_MOVE, MOST_MOVE)
        bias = float(np.clip(bias + 0.3 * (y - p).mean(), -8, 8))
    return LineField(weights, bias, move)


def fit_lines(rows: list[tuple[int, str]], *, rounds: int = 60, again: int = 2, ridge: float = 1.0) -> LineField:
    """Fit on ``(bad, text)``.

    First each line is told by itself, with its document's label, ``again`` times
    anew with what that makes of the lines of bad documents; links between the
    tags so found are fitted last. With links from the start, every line of a
    bad document would keep its label because of the others.
    """
    read = [(int(bad), read_lines(t).features) for bad, t in rows]
    read = [(bad, f) for bad, f in read if f]
    if not read or len({bad for bad, _ in read}) < 2:
        return LineField(np.zeros(N_FEATURES), -4.0, np.zeros((2, 2)))  # nothing to tell apart: all is content
    x = np.concatenate([np.array(f) for _, f in read])
    ends = np.cumsum([len(f) for _, f in read])
    starts = ends - [len(f) for _, f in read]
    y = np.repeat([bad for bad, _ in read], [len(f) for _, f in read]).astype(float)
    field = _ascend(x, y, starts, ends, rounds, ridge, linked=False)
    for k in range(again):
        tags = [np.array(field.decode(f), float) if bad else np.zeros(len(f)) for bad, f in read]
        # a bad document of which nothing would be left as boilerplate keeps its label on every line
        y = np.concatenate([np.ones(len(t)) if bad and not t.any() else t for (bad, _), t in zip(read, tags, strict=True)])
        field = _ascend(x, y, starts, ends, rounds, ridge, linked=k == again - 1)
    return field


def fit_line_field(docs: DataFrame, labels: DataFrame, *, per_label: int = 1000, max_bytes: int = 20_000) -> LineField:
    """Fit on at most ``per_label`` good and bad texts of at most ``max_bytes`` bytes; held-out rows and null labels aren't used."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = docs.select("doc_id", "text", F.octet_length("text").alias("size"), draw("doc_id", "text").alias("draw")).join(marked, "doc_id")
    return fit_lines([(int(r["label"] == 0), r["text"]) for r in labelled_sample(known, per_label, max_bytes)])


def label_lines(docs: DataFrame, field: LineField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: its counts, whether it fails the base rules, whether it is kept, and where its boilerplate is.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share, boilerplate``; the last has the character
    offsets (start, end) of boilerplate lines, neighbours merged. A document is
    kept if it passes the base rules and at least half of its words lie in
    content lines. Null and empty texts have no word, fail and have a content
    share of 0. Lines are told apart by ``\\n`` alone and lines without a word
    are skipped. Whole texts are read, of any length. Repeated rows and null
    identifiers are rows like any other; an empty table gives an empty result;
    further columns, with whatever names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a weight for each of N_FEATURES
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def decide(text: str | None, model: LineField):
        found = read_lines(text)
        n, tags = found.n_words, model.decode(found.features)
        content = sum(len(ws) for ws, tag in zip(found.words, tags, strict=True) if not tag)
        failed = n < LEAST_WORDS or 100 * found.n_repeat_words > MOST_REPEATED * n
        spans: list[dict] = []
        last = -2
        for i, tag in enumerate(tags):
            if tag:
                if last == i - 1:
                    spans[-1]["end"] = found.spans[i][1]
                else:
                    spans.append({"start": found.spans[i][0], "end": found.spans[i][1]})
                last = i
        share = content / n if n else 0.0
        return (n, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, failed, not failed and share >= CONTENT_SHARE, share, spans)

    def run(batches):
        model = shared.value
        for batch in batches:
            made = [decide(t.as_py(), model) for t in batch.column(1)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate([pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), span])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names, "base_failed", "kept", "content_share", "boilerplate"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, content_share double, boilerplate array<struct<start:long,end:long>>"
    return source.mapInArrow(releasing(run), schema)


def line_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that aren't held out and decide on all; see ``label_lines``. Adds ``held_out``."""
    found = label_lines(docs, fit_line_field(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), *[c for c in found.columns if c != "doc_id"])
