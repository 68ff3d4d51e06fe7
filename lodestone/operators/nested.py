"""Differences of nested documents, level by level, for whole tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import stored

#: Levels after which what is left is compared as a whole.
MOST_LEVELS = 100


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _plain(v: Column) -> Column:
    """A value as JSON, its keys in order; null for a missing one and for JSON's own null."""
    return F.nullif(F.to_json(v), F.lit("null"))


def nested_differences(left: DataFrame, right: DataFrame, key: str, document: str) -> DataFrame:
    """``(key, path, left, right)``: where the JSON documents of equal keys differ, with both values as JSON.

    Objects on both sides are taken apart, their fields joined by name, and so
    on; anything else is compared as it is, arrays too. A field that one side
    lacks, or a document, counts as null, like one that says null; documents
    that aren't JSON are an error. Each level is one full outer join of all
    documents' fields; there are as many as the deepest pair has. Keys are one
    a document; null keys meet nothing.
    """
    spark = left.sparkSession
    sides = [t.select(F.col(key).alias("key"), F.parse_json(document).alias(n)) for t, n in ((left, "a"), (right, "b"))]
    pairs = sides[0].join(sides[1], "key", "full_outer").select("key", F.lit("").alias("path"), "a", "b")
    out = None
    for level in range(MOST_LEVELS):
        apart = F.lit(level < MOST_LEVELS - 1) & _is_object(F.col("a")) & _is_object(F.col("b"))
        pairs = stored(pairs.withColumn("apart", apart), "nested")
        found = pairs.where(~F.col("apart")).select("key", "path", _plain(F.col("a")).alias("left"), _plain(F.col("b")).alias("right")).where(~F.col("left").eqNullSafe(F.col("right")))
        out = found if out is None else out.unionByName(found)
        deeper = pairs.where("apart")
        if deeper.isEmpty():
            break
        fields = []
        for side in ("a", "b"):
            # names of the table function's own columns clash with the key's: they are told apart by place
            each = deeper.select("key", "path", F.col(side).alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).toDF("key", "path", "v", "pos", "field", side)
            fields.append(each.select("key", F.concat_ws(".", F.nullif("path", F.lit("")), "field").alias("path"), side))
        pairs = fields[0].join(fields[1], ["key", "path"], "full_outer").select("key", "path", "a", "b")
    return out.withColumnRenamed("key", key)
