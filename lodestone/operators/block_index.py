"""BM25 that skips: postings in blocks, each with the greatest part of a score that it can add.

The rare terms of a query give a score that its k-th hit has at least. Blocks
whose greatest parts don't add up to it can't hold a hit, and their postings,
most of those of frequent words, are never taken apart.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import search_tokens
from lodestone.operators.retrieval import PLACES, TextIndex, by_item, small, top_k
from lodestone.session import stored

#: What bounds and scores may differ by when they are added up in another order.
SLACK = 10.0**-PLACES


def _part(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """What a term adds to a score, but for its weight."""
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


@dataclass
class BlockIndex:
    """``blocks(term, block, most, postings)``, ``terms(term, df)``, ``totals(n, avgdl)``; for one ``k1`` and ``b``."""

    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame
    k1: float
    b: float

    @staticmethod
    def build(index: TextIndex, path: str | None = None, *, k1: float = 1.5, b: float = 0.75, size: int = 128) -> BlockIndex:
        """The blocks of an inverted index, saved in the folder ``path`` if there is one.

        Items of about the same length share blocks of about ``size`` items, as
        their parts are alike; a block of a term is one row, whatever the
        number of items that have the term.
        """
        spark = index.postings.sparkSession
        kind = F.floor(4 * F.log2(F.greatest(F.max("dl").over(Window.partitionBy("item_id")), F.lit(1)).cast("double"))).cast("int")  # an item has one, whatever its rows
        postings, terms, totals = (stored(t, n) for t, n in ((index.dealt().withColumn("kind", kind), "postings"), (index.terms, "terms"), (index.totals, "totals")))
        counts = postings.select("item_id", "kind").distinct().groupBy("kind").agg(F.ceil(F.count("*") / size).cast("bigint").alias("n_blocks"))
        placed = postings.join(F.broadcast(counts), "kind")  # at most 4 x 63 rows, as lengths are longs
        block = F.col("kind").cast("bigint") * (1 << 40) + F.pmod(F.xxhash64("item_id"), "n_blocks")
        made = placed.crossJoin(F.broadcast(totals)).withColumns({"block": block, "part": _part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)})  # one row
        blocks = made.groupBy("term", "block").agg(F.max("part").alias("most"), F.collect_list(F.struct("item_id", "part")).alias("postings"))
        if path is None:
            return BlockIndex(stored(blocks, "blocks"), terms, totals, k1, b)
        for name, rows in (("blocks", blocks), ("terms", terms), ("totals", totals.withColumn("about", F.lit(json.dumps({"k1": k1, "b": b}))))):
            rows.write.parquet(f"{path.rstrip('/')}/{name}")
        return BlockIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BlockIndex:
        blocks, terms, totals = (spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("blocks", "terms", "totals"))
        about = json.loads(totals.first()["about"])
        return BlockIndex(blocks, terms, totals.drop("about"), about["k1"], about["b"])

    def search(self, queries: DataFrame, k: int, tokens=search_tokens, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The hits of ``bm25_top_k``, and ``(query_id, blocks, scored)``: how many blocks have a term of the query, and how many were taken apart.

        ``among(query_id, item_id)`` filters the hits; the statistics stay those
        of all items, and the threshold is one of the items that pass. Queries
        with fewer than ``k`` hits skip nothing.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
        weighed = asked.join(self.terms, "term").crossJoin(F.broadcast(self.totals))  # one row
        weighed = stored(weighed.select("query_id", "term", "df", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "weighed")
        # what is added up for an item or a block meets where the block is: pairs of items and queries don't move
        n_items, n_queries = self.totals.first()["n"], weighed.select("query_id").distinct().count()
        dealt = lambda rows: by_item(rows, "block", n_items, n_queries)
        if among is not None:
            members = dealt(self.blocks.select("block", F.explode("postings.item_id").alias("item_id"))).distinct()
            own = members.join(among.groupBy("item_id").agg(F.collect_set("query_id").alias("queries")), "item_id")
            own = stored(own.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "queries"))).alias("queries")), "among")

        def scores(pairs: DataFrame) -> DataFrame:
            """Of ``(query_id, idf, block, postings)``, dealt by block; an item has one block."""
            rows = pairs if among is None else pairs.join(dealt(own), "block")
            rows = rows.withColumn("p", F.explode("postings"))
            if among is not None:
                rows = rows.where(F.array_contains(F.element_at("queries", F.col("p.item_id")), F.col("query_id")))
            found = rows.select("query_id", "block", "p.item_id", (F.col("idf") * F.col("p.part")).alias("part"))
            return found.groupBy("query_id", "block", "item_id").agg(F.sum("part").alias("score")).drop("block")

        # the rarest terms, until their items are enough to hold k hits
        rising = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        rare = weighed.withColumn("before", F.coalesce(F.sum("df").over(rising), F.lit(0))).where(F.col("before") < 4 * k)
        rare = stored(rare.select("query_id", "term", "idf"), "rare")
        few = dealt(self.blocks.join(small(rare.select("term")), "term", "left_semi").select("term", "block", "postings"))
        first = top_k(scores(few.join(small(rare), "term")), k)
        least = stored(first.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least")), "least")
        bounds = dealt(self.blocks.select("term", "block", "most")).join(small(weighed), "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        judged = bounds.join(small(least), "query_id", "left").withColumn("scored", F.coalesce(F.col("bound") >= F.col("least") - SLACK, F.lit(True)))
        judged = stored(judged.select("query_id", "block", "scored"), "judged")
        asking = dealt(judged.where("scored")).groupBy("block").agg(F.collect_set("query_id").alias("asking"))
        kept = dealt(self.blocks.select("term", "block", "postings")).join(asking, "block").join(small(weighed.select("query_id", "term", "idf")), "term").where(F.array_contains("asking", F.col("query_id")))
        report = judged.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if("scored").alias("scored"))
        return top_k(scores(kept).where("score > 0"), k), report
