"""Intervals of positions that meet: chunks with sections, evidence with chunks.

Intervals lie half-open in a document, ``[start, end)``. Two of them meet in a bin
of positions as wide as the longer one: so a long document is many keys, no key
holds more than what nearly touches, and nothing is compared across a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The nine ways in which a chunk comes to its section (fixed values).
NO_SECTIONS, SOLE, DOCUMENT, CONTAINED, SPANNING, OVERLAP, NONE, NONE_FALLBACK, NOT_FOUND = (
    "no_sections", "sole_section", "document_level_fallback", "fully_contained", "boundary_spanning", "overlap_based", "no_overlap", "no_overlap_fallback", "text_not_found",
)


def _level(start: Column, end: Column) -> Column:
    """The least power of two that isn't shorter than the interval."""
    return F.ceil(F.log2((end - start).cast("double"))).cast("int")


def interval_join(left: DataFrame, right: DataFrame, on: str, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Inner join of rows of equal ``on`` whose half-open ranges share a position.

    Every interval stands in the bins of its own width, at most two of them. It
    is looked for in those of each greater width that the other side has. A pair
    meets once, where the overlap begins, at the width of its longer interval.
    Rows with a null or empty range meet nothing. Other columns of the two sides
    must have different names. Rows are copied once or twice for each width of
    the other side, of which there are 40 at most, so a hot document is dealt to
    many tasks, and the work follows the number of pairs that meet.
    """
    (a, b), (c, d) = left_range, right_range
    own = lambda rows, lo, hi: rows.where(F.col(hi) > F.col(lo)).withColumn("_own", _level(F.col(lo), F.col(hi)))
    one, two = own(left, a, b), own(right, c, d).withColumnRenamed(on, "_on").withColumnRenamed("_own", "_theirs")
    widths = lambda rows, name: sorted(r[0] for r in rows.select(name).distinct().collect())  # noqa: E731  at most 64 of each
    levels = {"left": widths(one, "_own"), "right": widths(two, "_theirs")}

    def binned(rows: DataFrame, lo: str, hi: str, level: Column) -> DataFrame:
        at = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_width"))).cast("bigint")
        made = rows.withColumn("_width", F.explode(level))
        return made.withColumn("_bin", F.explode(F.sequence(at(F.col(lo)), at(F.col(hi) - 1))))

    def upward(own_level: str, others: list[int], least: int) -> Column:
        return F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda w: w >= F.col(own_level) + least)

    begin = F.floor(F.greatest(F.col(a), F.col(c)) / F.pow(F.lit(2.0), F.col("_width"))).cast("bigint")
    meet = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("_bin") == begin)
    out = None
    # the left one at its own width, with all of the right that aren't wider; then the right one, with all of the left that are narrower
    for x, y in (
        (binned(one, a, b, F.array("_own")), binned(two, c, d, upward("_theirs", levels["left"], 0))),
        (binned(one, a, b, upward("_own", levels["right"], 1)), binned(two, c, d, F.array("_theirs"))),
    ):
        same = (F.col(on) == F.col("_on")) & (F.col("_width") == F.col("_w")) & (F.col("_bin") == F.col("_b"))
        met = x.join(y.withColumnsRenamed({"_width": "_w", "_bin": "_b"}), same).where(meet).drop("_own", "_theirs", "_on", "_width", "_bin", "_w", "_b")
        out = met if out is None else out.unionByName(met)
    return out


def _meetings(chunks: DataFrame, sections: DataFrame, candidates: bool) -> DataFrame:
    """For each chunk ``deep``, the best section that holds it, ``large``, the best of the others that it touches, and how many those are."""
    place = chunks.select("doc_id", "item_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    parts = sections.select("doc_id", "parent_id", "s_start", "s_end", "level", "ordinal")
    met = interval_join(place, parts, "doc_id", ("c_start", "c_end"), ("s_start", "s_end"))
    inside = (F.col("s_start") <= F.col("c_start")) & (F.col("s_end") >= F.col("c_end"))
    overlap = F.least("c_end", "s_end") - F.greatest("c_start", "s_start")
    named = [F.col("ordinal"), F.col("parent_id"), F.col("level")]
    deep = F.struct((-F.col("level")).cast("bigint").alias("x"), (F.col("s_end") - F.col("s_start")).cast("bigint").alias("y"), *named)
    large = F.struct((-overlap).cast("bigint").alias("x"), (-F.col("level")).cast("bigint").alias("y"), *named)
    sums = [F.min(F.when(inside, deep)).alias("deep"), F.min(F.when(~inside, large)).alias("large"), F.count_if(~inside).alias("around")]
    if candidates:
        sums += [F.array_sort(F.collect_list(F.when(c, x))).alias(n) for n, c, x in (("deeper", inside, deep), ("larger", ~inside, large))]
    every = place.groupBy("doc_id", "item_id").agg(F.max("c_start").alias("c_start"))
    return every.join(met.groupBy("doc_id", "item_id").agg(*sums), ["doc_id", "item_id"], "left")


def map_to_parents(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of each chunk: the deepest that contains it, else that with the largest overlap, else none.

    ``chunks(doc_id, item_id, start, end)``, ``sections(doc_id, parent_id, s_start, s_end, level, ordinal)``.
    """
    kind = F.when(F.col("deep").isNotNull(), "contained").when(F.col("large").isNotNull(), "overlap").otherwise("fallback")
    return _meetings(chunks, sections, False).select("doc_id", "item_id", F.coalesce("deep.parent_id", "large.parent_id").alias("parent_id"), kind.alias("mapping"))


def map_to_sections(chunks: DataFrame, sections: DataFrame, candidates: bool = False) -> DataFrame:
    """``(doc_id, item_id, parent_id, mapping, boundary_spanning[, candidates])``: the section of each chunk, and in which of nine ways it came to it.

    ``chunks(doc_id, item_id, start, end)``, a null start for text that wasn't
    found; ``sections(doc_id, parent_id, s_start, s_end, level, ordinal)``, a null
    start for a section whose text wasn't found. The deepest section that holds a
    chunk whole is its parent (then the shortest, then the first); without one,
    that with the largest overlap (then the deepest, the first); without any, the
    first section of the document. Documents of one section need no positions,
    those without any give null. ``candidates`` adds the other sections that met
    the chunk, best first. Sections may overlap in any way; repeated item
    identifiers of a document count as one chunk.
    """
    per_doc = sections.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("s_start").isNotNull(), F.struct("s_start", "ordinal", "parent_id"))).alias("first"),
        F.min(F.struct("ordinal", "parent_id", "level")).alias("only"),
    )
    rows = _meetings(chunks, sections, candidates).join(per_doc, "doc_id", "left")
    placed = (F.col("n") > 1) & F.col("c_start").isNotNull()
    mapping = (
        F.when(F.col("n").isNull(), NO_SECTIONS)
        .when(F.col("n") == 1, F.when(F.col("only.level") == 0, DOCUMENT).otherwise(SOLE))
        .when(F.col("c_start").isNull(), NOT_FOUND)
        .when(F.col("deep").isNotNull(), F.when(F.col("deep.level") == 0, DOCUMENT).otherwise(CONTAINED))
        .when(F.col("around") > 1, SPANNING).when(F.col("around") == 1, OVERLAP)
        .when(F.col("first").isNotNull(), NONE_FALLBACK).otherwise(NONE)
    )
    parent = F.when(F.col("n") == 1, F.col("only.parent_id")).when(placed, F.coalesce("deep.parent_id", "large.parent_id", "first.parent_id"))
    columns = ["doc_id", "item_id", parent.alias("parent_id"), mapping.alias("mapping"), (mapping == SPANNING).alias("boundary_spanning")]
    if candidates:
        ids = lambda c: F.transform(F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda s: s["parent_id"])
        none = F.array().cast(f"array<{sections.schema['parent_id'].dataType.simpleString()}>")
        others = F.when(F.col("deep").isNotNull(), ids("deeper")).when(F.col("around") > 0, F.filter(ids("larger"), lambda p: p != F.col("large.parent_id")))
        columns.append(F.when(placed, F.coalesce(others, none)).otherwise(none).alias("candidates"))
    return rows.select(*columns)


def span_overlaps(spans: DataFrame, chunks: DataFrame, unmapped: str = "error") -> DataFrame:
    """Evidence spans and the chunks that they touch, with coverage of both; ``is_primary`` marks the best of a span.

    ``spans(span_id, doc_id, s_start, s_end, ...)``, ``chunks(doc_id, item_id, start,
    end, ...)``. A span that touches no chunk is an error when the result is read
    (``unmapped="error"``), a row without a chunk and with ``mapping_status``
    ``unmapped`` (``"report"``) or left out (``"drop"``). Null and empty spans
    touch nothing. The best has the largest overlap, then the largest coverage;
    ties go to the smallest ``item_id``.
    """
    if unmapped not in ("error", "report", "drop"):
        raise ValueError("unmapped must be error, report or drop")
    met = interval_join(spans, chunks, "doc_id", ("s_start", "s_end"), ("start", "end"))
    overlap = F.least("s_end", "end") - F.greatest("s_start", "start")
    met = met.withColumn("overlap", overlap)
    met = met.withColumns({"evidence_coverage": F.round(F.col("overlap") / (F.col("s_end") - F.col("s_start")), 6), "chunk_coverage": F.round(F.col("overlap") / (F.col("end") - F.col("start")), 6)})
    order = Window.partitionBy("span_id").orderBy(F.col("overlap").desc(), F.col("evidence_coverage").desc(), "item_id")
    made = met.withColumn("is_primary", F.row_number().over(order) == 1).withColumn("mapping_status", F.lit("mapped"))
    if unmapped == "drop":
        return made
    lost = spans.join(met.select("span_id").distinct(), "span_id", "left_anti")
    if unmapped == "error":
        told = F.raise_error(F.concat(F.lit("an evidence span touches no chunk: "), F.col("span_id").cast("string")))
        lost = lost.withColumn("mapping_status", told.cast("string"))
    else:
        lost = lost.withColumn("mapping_status", F.lit("unmapped"))
    return made.unionByName(lost.withColumn("is_primary", F.lit(False)), allowMissingColumns=True)
