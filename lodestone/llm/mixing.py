"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions alone.

A document's key is ``-ln(u) / quality``, with ``u`` from a hash of its
identifier; sorted by it, documents of a source come in the order of a weighted
sample without replacement. Complete epochs take every document whole; the rest
of the target goes down the sorted keys until the budget is used up, and the
document at the edge gives what is missing. The running sums are taken in two
levels, as a source may hold a third of all rows: sums of key ranges first, then
inside each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

#: Weights of the sources in the order of their names, repeating (the contract's fixed value).
WEIGHTS = (5, 2, 1)


def target_sizes(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, rounds: int = 64) -> DataFrame:
    """``(name, source_size, target)`` from ``(name, source, source_size)``.

    The targets share ``share`` of all sizes by weight. What exceeds ``most``
    times a source's size is shared again by weight among the others. In the
    order of size by weight, the sources that stop are the first ones: one
    running sum finds them, so there is no loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    whole = Window.partitionBy()
    ratio = F.col("source_size") / F.col("weight")
    up_to = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    ranked = listed.withColumn("ratio", ratio).withColumns({
        "pool": F.sum("source_size").over(whole) * F.lit(float(share)),
        "weights": F.sum("weight").over(whole),
        "stopped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)),
        "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # a source stops if its share of what the smaller ones leave exceeds its limit; so do all before it
    level = (F.col("pool") - F.col("stopped")) / (F.col("weights") - F.col("gone"))
    ranked = ranked.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > F.col("source_size") * F.lit(float(most)))
    final = F.min(F.when(~F.col("stops"), F.struct("ratio", "level"))).over(whole)["level"]
    limit = F.col("source_size") * F.lit(float(most))
    return ranked.select("name", "source_size", F.when(F.col("stops") | final.isNull(), limit).otherwise(F.least(limit, final * F.col("weight"))).alias("target"))


def exponential_key(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """Efraimidis and Spirakis' key, from 60 bits of an MD5 of identifier and text: the smaller, the earlier a document is drawn. Rows without an identifier, or with one that many share, have keys of their own."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 60))) / F.greatest(quality, F.lit(1e-6))


def label_quality(labels: DataFrame, low: float = 0.25) -> DataFrame:
    """``(doc_id, quality)``: documents labelled as poor weigh ``low``, the others 1."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, low).otherwise(1.0).alias("quality"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, quality: DataFrame | None = None, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, ranges: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: ``doc_id, source, size, source_size, target, taken, epochs``, and the columns to ``carry`` along.

    ``size`` is the number of words, 0 for null and empty texts; ``quality(doc_id,
    quality)`` weighs documents (1 where it has none). Every document is taken
    ``epochs`` whole times, as the target has complete epochs; ``taken`` counts
    words with repeats. A null source is a source of its own, the last by name.
    Repeated rows are documents of their own; equal keys, which only rows of one
    identifier and text have, go by identifier and size. Texts of any length
    count whole. An empty table gives an empty result; further columns, with
    whatever names, are ignored. Reruns agree.
    """
    draw = exponential_key(F.col(doc_id), F.col(text), F.lit(1.0), seed)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), draw.alias("key"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    if quality is not None:
        weighed = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
        sized = sized.join(weighed, "doc_id", "left")
    else:
        sized = sized.withColumn("quality", F.lit(1.0))
    sized = materialize(
        sized.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # never null
        .withColumn("key", F.col("key") / F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(1e-6)))
        # equal steps of the key's distribution function cut every source in ranges of about as many documents
        .withColumn("part", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int")),
        "mix-sizes",
    )
    parts = materialize(sized.groupBy("name", "source", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    targets = target_sizes(parts.groupBy("name", "source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.withColumn("begun", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    begun = begun.join(targets, "name").select("name", "part", "begun", "source_size", "target")
    within = Window.partitionBy("name", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(begun, ["name", "part"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("begun") - F.col("inside")
    return joined.withColumn("epochs", epochs).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
        "epochs",
        *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)),
    )
