"""How the words of each source differ from those of the other sources of a language, counted exactly.

Most distinct terms of a corpus stand in one or two documents and can't be kept.
A first pass adds up a count-min sketch of document frequencies, which never
underestimates; a second pass drops the terms that the sketch rules out where
they are read, before anything is shuffled, and counts the others exactly. What
the sketch lets through wrongly falls to the exact counts. Sources are then
compared through joins of the terms that they have: a term that neither has
adds the same to every pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, releasing

#: Bytes of a term: letters, of ASCII in lower case, and all that isn't ASCII (fixed values).
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Every byte of a term in lower case, any other one a space.
FOLDED = bytes(c if TERM.match(bytes([c])) else 0x20 for c in range(256)).lower()
#: Rows and cells in a row of the sketch, and the cells that travel together.
DEPTH, WIDTH, BLOCK = 4, 1 << 21, 1 << 17
#: Counts that a task holds before it gives them on; bytes of texts that are cut at once.
HELD, SLICE = 1_000_000, 1 << 23
#: Parts of a probability of 1 (fixed value).
UNIT = 1_000_000_000


def long_text(text: bytes) -> Counter:
    """How often each term stands in a text that is cut slice by slice, between terms."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text) and (last := TERM.match(text, end)) and TERM.match(text, end - 1):
            end = last.end()
        out.update(text[at:end].translate(FOLDED).split())
        at = end
    return out


def _of_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of binary texts: the text and the number of each distinct term of each text, the terms, and how often they stand there."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(FOLDED)
    plain = pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data)])
    lists = pc.split_pattern(plain, " ")
    words = lists.flatten()
    text = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    text = text[some.to_numpy(zero_copy_only=False)]
    coded = words.filter(some).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    both, n = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return both // size, both % size, coded.dictionary, n


def counted(batch: pa.RecordBatch, groups: dict[tuple, int], by: tuple[int, ...]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Counts of a batch's texts (its third column) by the columns ``by``: group number, term, texts that have it, and how often it stands there.

    ``groups`` numbers the groups. Texts are cut some megabytes at a time, longer
    ones by themselves.
    """
    names = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
    group = np.array([groups.setdefault(g, len(groups)) for g in names], np.int64)
    sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        if sizes[at] > SLICE:
            found = long_text(batch.column(2)[at].as_py())
            yield np.full(len(found), group[at]), pa.array(list(found), pa.binary()), np.ones(len(found), np.int64), np.fromiter(found.values(), np.int64, len(found))
            at += 1
            continue
        end, held = at, 0
        while end < len(sizes) and sizes[end] <= SLICE and held + sizes[end] <= SLICE:
            held += sizes[end]
            end += 1
        text, term, terms, n = _of_texts(batch.column(2).slice(at, end - at))
        size = max(len(terms), 1)
        both, where = np.unique(group[at:end][text] * size + term, return_inverse=True)
        yield both // size, terms.cast(pa.binary()).take(pa.array(both % size)), np.bincount(where, minlength=len(both)), np.bincount(where, n, len(both)).astype(np.int64)
        at = end


def cells(lang: bytes, terms: Iterable[bytes], width: int) -> np.ndarray:
    """The cell of each term of a language in each row of the sketch, rows one after the other: ``DEPTH x terms``."""
    seed = xxhash.xxh32_intdigest(lang)
    first = np.array([xxhash.xxh64_intdigest(t, seed) for t in terms], np.uint64)
    # two independent halves give every row its own cell
    a, b = (first >> np.uint64(32)).astype(np.int64), (first & np.uint64(0xFFFFFFFF)).astype(np.int64) | 1
    return np.stack([(a + row * b) % width + row * width for row in range(DEPTH)])


def document_frequency_sketch(texts: DataFrame, least: int, width: int = WIDTH) -> bytes:
    """A count-min sketch of the document frequencies of ``texts(lang, source, text)``, all binary, by language and term.

    Cells stop at ``least``, so each is a byte and sums stay right up to there.
    Tasks give their sketches in blocks; those of one block are added up as they
    stream by, and the merged sketch, ``DEPTH * width`` bytes whatever the
    input, is what the driver gets.
    """
    blocks = -(-DEPTH * width // BLOCK)

    def sketch(batches):
        table, langs = np.zeros(blocks * BLOCK, np.uint8), {}
        for batch in batches:
            for group, terms, df, _ in counted(batch, langs, (0,)):
                for (lang,), number in langs.items():
                    mine = np.flatnonzero(group == number)
                    n = np.minimum(df[mine], least)
                    for row in cells(lang, terms.take(pa.array(mine)).to_pylist(), width):
                        where, which = np.unique(row, return_inverse=True)
                        table[where] = np.minimum(table[where] + np.bincount(which, n, len(where)), least).astype(np.uint8)
        some = [b for b in range(blocks) if table[b * BLOCK : (b + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([table[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in some], pa.binary())], names=["block", "cells"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(part.as_buffer(), np.uint8)
                total[block] = np.minimum(total[block] + more, least) if block in total else more.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "cells"])

    kind = "block int, cells binary"
    merged = texts.mapInArrow(releasing(sketch), kind).repartition("block").mapInArrow(merge, kind)
    out = bytearray(blocks * BLOCK)
    for r in merged.collect():  # bounded: DEPTH * width bytes
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["cells"]
    return bytes(out)


def surviving_counts(texts: DataFrame, sketch: bytes, least: int, width: int = WIDTH) -> DataFrame:
    """``(lang, source, term, df, n)``, partial sums, of the terms that the sketch gives ``least`` documents or more."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)  # DEPTH * width bytes

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        groups: dict[tuple, int] = {}
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["g", "term"], use_threads=False).aggregate([("df", "sum"), ("n", "sum")])

        def give(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            lang, source = (pa.array(x, pa.binary()) for x in zip(*groups, strict=True))
            for part in rows.combine_chunks().to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([lang.take(part["g"]), source.take(part["g"]), part["term"], part["df_sum"], part["n_sum"]], names=["lang", "source", "term", "df", "n"])

        for batch in batches:
            for group, terms, df, n in counted(batch, groups, (0, 1)):
                kept = np.zeros(len(group), bool)
                names = [g[0] for g in groups]
                number = {lang: i for i, lang in enumerate(dict.fromkeys(names))}
                langs = np.array([number[x] for x in names], np.int64)[group]
                for lang, i in number.items():
                    mine = np.flatnonzero(langs == i)
                    if len(mine):
                        once = terms.take(pa.array(mine)).dictionary_encode()
                        fine = table[cells(lang, once.dictionary.to_pylist(), width)].min(0) >= least
                        kept[mine] = fine[once.indices.to_numpy(zero_copy_only=False)]
                at = pa.array(np.flatnonzero(kept))
                held.append(pa.table({"g": pa.array(group[kept]), "term": terms.take(at), "df": pa.array(df[kept]), "n": pa.array(n[kept])}))
                if sum(t.num_rows for t in held) >= HELD:
                    held = [summed().rename_columns(["g", "term", "df", "n"])]
                    if held[0].num_rows >= HELD // 2:
                        yield from give(held[0].rename_columns(["g", "term", "df_sum", "n_sum"]))
                        held = []
        if held and groups:
            yield from give(summed())

    return texts.mapInArrow(releasing(run), "lang binary, source binary, term binary, df long, n long")


def _share(n: Column, total: Column, v: Column) -> Column:
    """``1 + floor(UNIT * (n + 1) / (total + v))`` in whole numbers of any size."""
    div = lambda a, b: F.call_function("div", a, b)
    wide = div(F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))
    return (1 + F.when(n < 1 << 32, div(F.lit(UNIT).cast("bigint") * (n + 1), total + v)).otherwise(wide)).cast("bigint")


def _f(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / q)``; at most 10**18."""
    return F.call_function("div", (p - q) * (p - q), q)


def _halves(value: Column) -> list[Column]:
    """Sums of the high and the low half of longs, so that no sum overflows."""
    return [F.sum(F.shiftright(value, 32)).alias("high"), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias("low")]


def source_divergence(docs: DataFrame, *, least: int = 3, top: int = 200, width: int = WIDTH, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of each language all other sources by how far their words are from its own (part ``pair``), and the ``top`` terms that it has more of than its language (part ``term``).

    A language keeps the terms that stand in ``least`` of its documents. Shares
    of terms are whole billionths with one added to each count, divergences sums
    of ``floor((p-q)**2/q)``; all arithmetic is exact. Null texts, languages and
    sources count as empty strings; a source whose documents have no term is a
    source like any other; a language that keeps no term has pairs of value 0.
    Whole texts count, of any length. Repeated rows are documents of their own;
    ties go by the item's bytes; an empty table gives an empty result; further
    columns, with whatever names, are ignored. The sketch saves shuffling only
    and changes no result, whatever its ``width``.
    """
    whole = docs.select(*(F.coalesce(F.col(c), F.lit("")).cast("string").alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    texts = whole.select(*(F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")))
    parts = surviving_counts(texts, document_frequency_sketch(texts, least, width), least, width)
    # all rows of a term of a language meet once: they are counted by source, and then judged, where they are
    counted_rows = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    of_term = Window.partitionBy("lang", "term")
    judged = counted_rows.select("*", F.sum("df").over(of_term).alias("all_df"), F.sum("n").over(of_term).alias("lang_n"), F.min("source").over(of_term).alias("first"))
    named = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    rows = materialize(judged.where(F.col("all_df") >= least).select(*named, "n", "lang_n", (F.col("source") == F.col("first")).alias("first")), "divergence-counts")

    groups = whole.select("lang", "source").distinct()
    sizes = rows.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda *names: [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in names]
    sized = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", *zero("v", "lang_total", "total"))
    absent = F.when(F.col("v") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))).otherwise(1)
    sized = materialize(sized.withColumn("p0", absent), "divergence-groups")  # a row for each source of a language
    shared = materialize(rows.drop("first").join(sized, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v"))), "divergence-shares", replaces=rows)

    # terms that a source has more of than its language
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    above = shared.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # pairs: what all terms would give if neither source had any, then what those of one source change, then those of both
    mine, other = (sized.select("lang", F.col("source").alias(s), F.col("p0").alias(p), "v") for s, p in (("source", "p0"), ("item", "q0")))
    pairs = mine.join(other.drop("v"), "lang").where("source <> item")
    f = lambda p, q: _f(F.col(p), F.col(q))
    whole_number = lambda c: c.cast("decimal(38,0)").alias("value")
    none = pairs.select("lang", "source", "item", whole_number(F.col("v") * f("p0", "q0").cast("decimal(20,0)")))
    # a source has few different shares: terms of the same share change a pair alike
    alike = shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    wide = lambda p, q: f(p, q).cast("decimal(20,0)")
    of_one = alike.join(other.drop("v"), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (wide("p", "q0") - wide("p0", "q0"))).alias("value"))
    theirs = alike.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), "terms")
    of_other = theirs.join(mine.drop("v"), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (wide("p0", "q") - wide("p0", "q0"))).alias("value"))
    left = shared.select("lang", "term", "source", "p", "p0")
    right = shared.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).where("source <> item")
    of_both = both.groupBy("lang", "source", "item").agg(*_halves(f("p", "q") - f("p", "q0") - f("p0", "q") + f("p0", "q0")))
    of_both = of_both.select("lang", "source", "item", (F.col("high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")).alias("value"))
    summed = none
    for more in (of_one, of_other, of_both):
        summed = summed.unionByName(more.select("lang", "source", "item", whole_number(F.col("value"))))
    compared = summed.groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = compared.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(terms)
