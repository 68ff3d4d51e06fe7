"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, held_out, materialize


#: Times the rows wanted that are expected below the threshold: it holds too few of them once in e**-80 cases for 100 rows.
MARGIN = 4


def draw(doc_id: str, text: str) -> Column:
    """53 bits of a hash of identifier and text; to be taken where the texts are read, before any join."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 11)


def labelled_sample(rows: DataFrame, per_label: int, max_bytes: int) -> list:
    """At most ``per_label`` of ``rows(doc_id, label, text, size, draw)`` for each label, the first in the order of a hash of identifier and text.

    Held-out rows, null labels and texts, empty texts and texts of over
    ``max_bytes`` bytes are left out. Rows that repeat an identifier and a text
    count once. Rows are chosen by their hashes, so texts that aren't taken
    never move.
    """
    able = rows.where(~held_out() & F.col("label").isNotNull() & F.col("doc_id").isNotNull() & F.col("size").between(1, max_bytes))
    draws = materialize(able.select("label", "draw"), "sample-draws")
    # the first hashes of a label lie below a threshold that follows from how many it has: only rows below it meet
    sizes = draws.groupBy("label").agg(F.approx_count_distinct("draw").alias("rows")).collect()  # bounded as the sample is: a row for each label
    if not sizes:
        forget(draws)
        return []
    cuts = F.create_map(*[x for r in sizes for x in (F.lit(r["label"]), F.lit(MARGIN * per_label / r["rows"] * float(1 << 53)))])
    below = draws.where(F.col("draw") <= cuts[F.col("label")]).distinct()
    order = Window.partitionBy("label").orderBy("draw")
    chosen = below.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label).select("draw")
    picked = sorted({r[0] for r in chosen.collect()})  # bounded: labels times per_label
    taken = able.where(F.col("draw").isin(picked)).dropDuplicates(["draw", "label"]).select("doc_id", "label", "text")
    out = sorted(taken.collect(), key=lambda r: (str(r["label"]), r["doc_id"], r["text"]))
    forget(draws)
    return out
