"""Sharding by extendible hashing, with DataFrame functions alone.

A shard is a prefix of hash bits. The directory begins with the empty prefix,
and only buckets over the byte limit split on another bit. Sums are taken for a
stretch of bits at a time: the buckets still open are cut ``STRETCH`` bits
deeper, the cells' sizes are added up along their prefixes, and every prefix
that fits while its parent doesn't is a shard. Identifiers are spread by their
hash, so hot sources don't matter, and what is aggregated shrinks to a few
thousand cells before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS, STRETCH = 60, 12


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the identifier as text, most significant first; rows without an identifier hash by their text, so that they spread."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.substring(F.lpad(F.bin(bits), BITS, "0"), F.lit(1), depth))


def extendible_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, max_bytes: int = 1 << 20) -> DataFrame:
    """One row for each input row: ``doc_id, bytes, shard, depth, shard_bytes, page``.

    ``shard`` is the bucket's prefix of hash bits, ``depth`` their number,
    ``shard_bytes`` its size. ``bytes`` is the size of the text in UTF-8, 0 for
    null. A document over the limit fills a bucket of its own (``page`` 0). Rows
    of one identifier (or of none and one text) can't be told apart by bits: if they exceed the limit
    together, their bucket has overflow pages, filled in the order of size, each
    over the limit only by its last row; ``shard_bytes`` is then that of the
    whole bucket. An empty table gives an empty result.
    """
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), hash_bits(F.col(doc_id), F.col(text)).alias("bits")), "shard-sizes")
    waiting, done, begin = sized, [], 0
    while begin < BITS:
        end = min(begin + STRETCH, BITS)
        cell = F.shiftright("bits", BITS - end)
        cells = waiting.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("cell_bytes"))
        # every cell with the prefixes above it in this stretch, the open bucket itself included
        steps = F.sequence(F.lit(begin), F.lit(end))
        above = cells.withColumn("depth", F.explode(steps)).withColumn("head", F.expr(f"shiftright(cell, {end} - depth)"))
        sums = above.groupBy("depth", "head").agg(F.sum("cell_bytes").alias("shard_bytes"))
        fits = F.col("shard_bytes") <= max_bytes
        found = above.join(sums, ["depth", "head"]).groupBy("cell").agg(F.min(F.when(fits, F.struct("depth", "shard_bytes"))).alias("shard"))
        directory = materialize(found.select("cell", F.col("shard.depth").alias("depth"), F.col("shard.shard_bytes").alias("shard_bytes")), "shard-directory")
        placed = waiting.withColumn("cell", cell).join(directory, "cell")
        if end == BITS:
            done.append(placed.where("depth is not null"))
            waiting = placed.where("depth is null").drop("cell", "depth", "shard_bytes")
            break
        done.append(placed.where("depth is not null"))
        if directory.where("depth is null").isEmpty():
            waiting = None
            break
        waiting = materialize(placed.where("depth is null").drop("cell", "depth", "shard_bytes"), "shard-open")
        begin = end
    columns = ["doc_id", "bytes", _prefix(F.col("bits"), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes"]
    out = None
    for part in done:
        part = part.select(*columns, F.lit(0).cast("long").alias("page"))
        out = part if out is None else out.unionByName(part)
    if waiting is not None:
        whole = Window.partitionBy("bits")
        running = whole.orderBy("bytes").rowsBetween(Window.unboundedPreceding, -1)
        full = waiting.withColumn("shard_bytes", F.sum("bytes").over(whole)).withColumn("depth", F.lit(BITS))
        full = full.withColumn("page", F.floor(F.coalesce(F.sum("bytes").over(running), F.lit(0)) / F.lit(max_bytes)).cast("long"))
        out = out.unionByName(full.select(*columns, "page"))
    return out
