"""Saved vector indexes: an inverted file of lists, and a neighbour graph.

Both are folders of Parquet that any session can load and search again. Both
find most of the best vectors, not all; asked for everything (all lists, or the
exact fallback) they give what ``dense_top_k`` gives.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.retrieval import PLACES, _first_of_each, dense_top_k, top_k
from lodestone.session import stored

METRICS = ("cosine", "dot", "l2")
#: Bytes of doubles of the sample that centres are fitted on, and the most lists: both bound what the driver and each task hold.
SAMPLE_BYTES, MOST_LISTS = 128 << 20, 4096
#: Rows of one file of a list.
FILE_ROWS = 200_000


def _dimension(vectors: DataFrame) -> tuple[int, int]:
    """Number and length of the vectors; an error if they differ in length."""
    some = vectors.where(F.size("vector") > 0).agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if some["n"] and some["low"] != some["high"]:
        raise ValueError(f"an index holds vectors of one length; these have {some['low']} to {some['high']} components")
    return some["n"], some["high"] or 0


def _doubles(column: pa.Array, dim: int) -> np.ndarray:
    return pc.fill_null(column.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _directions(x: np.ndarray, metric: str) -> np.ndarray:
    """Cosines don't see lengths, so lists are made of directions."""
    if metric != "cosine":
        return x
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _nearness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """More for nearer centres; distances, as lists are cells."""
    return x @ centres.T - (centres * centres).sum(1) / 2


def fit_centres(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm on the rows of a sample. A centre that loses all its rows starts again from the row that lies worst."""
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        mine, near = np.empty(len(x), np.int64), np.empty(len(x))
        for lo in range(0, len(x), 4096):
            scores = _nearness(x[lo : lo + 4096], centres)
            mine[lo : lo + 4096] = scores.argmax(1)
            near[lo : lo + 4096] = scores.max(1) - (x[lo : lo + 4096] ** 2).sum(1) / 2
        sizes = np.bincount(mine, minlength=lists)
        order = np.argsort(mine, kind="stable")
        full = np.flatnonzero(sizes)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(sizes) - sizes)[full]) / sizes[full, None]
        worst = iter(np.argsort(near))
        for empty in np.flatnonzero(sizes == 0):
            centres[empty] = x[next(worst)]
    return centres


def calibrate(x: np.ndarray, centres: np.ndarray, metric: str, recall: float, k: int = 10, queries: int = 256, seed: int = 2) -> int:
    """The fewest lists that hold ``recall`` of the ``k`` best rows of a sample, found by comparing some of its rows with all."""
    at = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    mine = np.concatenate([_nearness(x[lo : lo + 4096], centres).argmax(1) for lo in range(0, len(x), 4096)])
    scores = x[at] @ x.T if metric != "l2" else 2 * x[at] @ x.T - (x * x).sum(1)
    scores[np.arange(len(at)), at] = -np.inf  # a row finds itself in the first list
    best = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    places = np.argsort(np.argsort(-_nearness(x[at], centres), axis=1), axis=1)
    needed = np.take_along_axis(places, mine[best], 1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else len(centres)


@dataclass
class InvertedFile:
    """Vectors stored under the list of their nearest centre; a search reads the ``nprobe`` lists nearest to each query."""

    spark: SparkSession
    path: str
    metric: str
    dim: int
    nprobe: int
    centres: np.ndarray
    schema: StructType

    @staticmethod
    def build(vectors: DataFrame, path: str, *, metric: str = "cosine", lists: int | None = None, recall: float = 0.95, seed: int = 1) -> InvertedFile:
        """Index ``vectors(item_id, vector, ...)`` in the folder ``path``; further columns are stored along.

        Centres are fitted on a sample, in the order of a hash of the identifier,
        of at most ``SAMPLE_BYTES`` of doubles; every vector is indexed. By
        default there are twice the root of the number of vectors, at most
        ``MOST_LISTS``. The default ``nprobe`` is what gives ``recall`` of the
        ten best within the sample. Null and empty vectors aren't indexed, as
        nothing finds them; vectors of several lengths are an error. A list of
        any size is written by as many tasks as its rows ask for.
        """
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {', '.join(METRICS)}")
        spark, (n, dim) = vectors.sparkSession, _dimension(vectors)
        rows = vectors.where(F.size("vector") > 0)
        if n:
            bound = max(1, SAMPLE_BYTES // (8 * dim))
            taken = rows.select("vector").orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(bound).toArrow()  # bounded
            sample = _directions(_doubles(taken["vector"].combine_chunks(), dim), metric)
            lists = max(1, min(lists or round(2 * n**0.5), MOST_LISTS, len(sample)))
            centres = fit_centres(sample, lists, seed=seed)
            nprobe = calibrate(sample, centres, metric, recall)
        else:
            centres, nprobe = np.zeros((1, max(dim, 1))), 1
        made = InvertedFile(spark, path.rstrip("/"), metric, max(dim, 1), nprobe, centres, rows.withColumn("list", F.lit(0)).schema)
        dealt = made._nearest(rows, "vector", 1).withColumn("list", F.element_at("list", 1))
        files = stored(dealt.groupBy("list").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files")), "list-files")  # a row for each list
        spread = dealt.join(F.broadcast(files), "list").withColumn("file", F.pmod(F.xxhash64("item_id"), F.col("files")))
        spread.repartition("list", "file").drop("files", "file").write.partitionBy("list").parquet(f"{made.path}/lists")
        about = json.dumps({"metric": metric, "dim": made.dim, "nprobe": nprobe, "schema": made.schema.json()})
        table = spark.createDataFrame([(i, c.tolist(), about) for i, c in enumerate(centres)], "list int, centre array<double>, about string")
        table.coalesce(1).write.parquet(f"{made.path}/centres")
        return made

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        rows = spark.read.parquet(f"{path.rstrip('/')}/centres").orderBy("list").collect()  # at most MOST_LISTS
        about = json.loads(rows[0]["about"])
        return InvertedFile(spark, path.rstrip("/"), about["metric"], about["dim"], about["nprobe"], np.array([r["centre"] for r in rows]), StructType.fromJson(json.loads(about["schema"])))

    def _nearest(self, rows: DataFrame, column: str, n: int) -> DataFrame:
        """``rows`` with ``list``, the numbers of the ``n`` nearest lists, nearest first."""
        shared = self.spark.sparkContext.broadcast(self.centres)  # bounded: MOST_LISTS
        at, dim, metric = rows.columns.index(column), self.dim, self.metric
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list array<int>"

        def run(batches):
            for whole in batches:
                step = max(1, (1 << 19) // len(shared.value))
                for lo in range(0, whole.num_rows, step):
                    batch = whole.slice(lo, step)
                    near = -_nearness(_directions(_doubles(batch.column(at), dim), metric), shared.value)
                    few = np.argpartition(near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
                    order = np.lexsort((few, np.take_along_axis(near, few, 1)), axis=1)
                    flat = np.take_along_axis(few, order, 1).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "list"])

        return rows.mapInArrow(run, kind)

    @property
    def items(self) -> DataFrame:
        """All that is stored, with its ``list``, by which it is partitioned."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, *, nprobe: int | None = None, within: str | list[str] | None = None, where: Column | None = None) -> DataFrame:
        """Hits of ``queries(query_id, query_vector, ...)`` as ``dense_top_k`` gives them, from the ``nprobe`` lists nearest to each.

        ``within`` names columns that query and item must share, ``where`` is a
        condition on the stored columns. Lists that no query probes aren't read.
        Queries that find fewer than ``k`` in their lists are searched again in
        all of them, so that what filters leave is never missed. Queries of
        another length, or without a vector, have no hits.
        """
        named = [within] if isinstance(within, str) else list(within or ())
        n = max(1, min(nprobe or self.nprobe, len(self.centres)))
        asked = queries.select("query_id", "query_vector", *named).where(F.size("query_vector") == self.dim)
        probes = stored(self._nearest(asked, "query_vector", n).withColumn("list", F.explode("list")), "probes")
        items = self.items if where is None else self.items.where(where)
        if n < len(self.centres):
            read = [r[0] for r in probes.select("list").distinct().collect()]  # at most MOST_LISTS
            first = self._best(probes, items.where(F.col("list").isin(read)), k, ["list", *named])
            first = stored(first, "hits")
            short = asked.join(first.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
            if short.isEmpty():
                return first
            again = self._best(short, items, k, named)
            return first.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
        return self._best(probes, items, k, ["list", *named])

    def _best(self, asked: DataFrame, items: DataFrame, k: int, within: list[str]) -> DataFrame:
        more = [c for c in items.columns if c not in ("item_id", "vector", "list")]
        hits = dense_top_k(asked, items.select("item_id", "vector", *within), k, self.metric, within).select("query_id", "item_id", "score", "rank")
        return hits.join(items.select("item_id", *more), "item_id") if more else hits


# ---- neighbour graph ----


def _pair_scores(pairs: DataFrame, metric: str, left: str, right: str) -> DataFrame:
    """``pairs`` with the score of their two vectors, which are dropped; rows of a batch at once."""
    keep = [c for c in pairs.columns if c not in (left, right)]
    kind = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    ordered = pairs.select(*keep, F.col(left).cast("array<double>").alias(left), F.col(right).cast("array<double>").alias(right))

    def run(batches):
        for batch in batches:
            n, made = batch.num_rows, batch.columns[: len(keep)]
            if n:
                dim = len(batch.column(len(keep))[0])
                a, b = (_doubles(batch.column(len(keep) + k), dim) for k in (0, 1))
                if metric == "l2":
                    score = -np.sqrt(((a - b) ** 2).sum(1))
                else:
                    score = (a * b).sum(1)
                    if metric == "cosine":
                        norms = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
                        score = np.divide(score, norms, out=np.zeros_like(score), where=norms > 0)
            else:
                score = np.empty(0)
            yield pa.RecordBatch.from_arrays([*made, pa.array(score)], names=[*keep, "score"])

    return ordered.mapInArrow(run, kind)


def _met(around: DataFrame, degree: int, metric: str) -> DataFrame:
    """``(a, b, score)``, both ways, of pairs of ``around(a, b, new, vector, least)``, sorted by ``a``, that meet around an ``a`` and of which one is new.

    A vector moves once to each ``a`` that it is near to, not once for each pair.
    Of those that meet, each gives up all but its ``degree`` best, and all below
    ``least``, the worst score of the ``degree`` that it has: what is worse than
    these isn't among its best of all.
    """
    item = around.schema["b"].dataType.simpleString()
    rows = around.select("a", "b", "new", F.col("vector").cast("array<double>").alias("vector"), "least")

    def score(ids: pa.Array, new: np.ndarray, v: np.ndarray, least: np.ndarray):
        if metric == "l2":
            made = -np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
        else:
            made = (v[:, None] * v[None]).sum(2)
            if metric == "cosine":
                norms = np.sqrt((v * v).sum(1))
                norms = norms[:, None] * norms[None]
                made = np.divide(made, norms, out=np.zeros_like(made), where=norms > 0)
        down = -np.nan_to_num(np.round(made, PLACES), nan=np.inf)  # NaN comes first, as in Spark's order
        may = (new[:, None] | new[None]) & ~(down > -least[:, None])
        np.fill_diagonal(may, False)
        row, column = np.nonzero(may)
        row, _, kept, best = _first_of_each(row, down[row, column], made[row, column], ids.take(pa.array(column)), degree)
        return ids.take(pa.array(row)), best, kept

    def run(batches):
        held, of = [], None  # the rows of one a, at most twice its degree, may lie in two batches

        def made():
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, new, v, least = (whole.column(c).combine_chunks() for c in ("b", "new", "vector", "least"))
            return score(ids, new.to_numpy(zero_copy_only=False), _doubles(v, len(v[0])), pc.fill_null(least, -np.inf).to_numpy())

        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(a[1:] != a[:-1]) + 1).tolist()
            found = []
            for lo, hi in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if held and a[lo] != of:
                    found.append(made())
                    held = []
                held.append(batch.slice(lo, hi - lo))
                of = a[lo]
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x[0] for x in found), pa.concat_arrays(x[1] for x in found), pa.array(np.concatenate([x[2] for x in found]))], names=["a", "b", "score"])
        if held:
            yield pa.RecordBatch.from_arrays([*(x := made())[:2], pa.array(x[2])], names=["a", "b", "score"])

    return rows.mapInArrow(run, f"a {item}, b {item}, score double")


@dataclass
class NeighbourGraph:
    """Every vector with its nearest neighbours; a search walks from neighbour to neighbour, for all queries at once."""

    spark: SparkSession
    path: str
    metric: str
    dim: int

    @staticmethod
    def build(vectors: DataFrame, path: str, *, metric: str = "cosine", degree: int = 16, rounds: int = 6, bucket: int = 256, least_change: float = 0.01, seed: int = 1) -> NeighbourGraph:
        """The graph of ``vectors(item_id, vector, ...)`` in the folder ``path``; further columns are stored along.

        Vectors first meet within random cells of about ``bucket`` of them.
        Then, round by round, neighbours of a common neighbour meet, as long as
        more than ``least_change`` of all edges change; only pairs with an edge
        that is new since the last round are compared. Each vector keeps its
        ``degree`` best, and its ``degree`` best admirers take part in a round:
        a vector that very many others are near to makes no more pairs than any
        other. Null and empty vectors aren't indexed; several lengths are an
        error. Identifiers are one a vector.
        """
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {', '.join(METRICS)}")
        spark, (n, dim) = vectors.sparkSession, _dimension(vectors)
        path = path.rstrip("/")
        vectors.where(F.size("vector") > 0).write.parquet(f"{path}/items")
        items = spark.read.parquet(f"{path}/items")
        x = items.select("item_id", "vector")
        # cells of random signs: near vectors share one more often than chance
        bits = max(0, int(n / bucket).bit_length()) if n > bucket else 0
        turn = np.random.default_rng(seed).standard_normal((bits, dim))
        sign = [F.aggregate(F.zip_with("vector", F.array(*map(F.lit, row.tolist())), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) > 0 for row in turn]
        cell = F.concat(F.lit("c"), *[F.when(s, "1").otherwise("0") for s in sign])
        celled = x.withColumn("cell", cell)
        met = dense_top_k(celled.select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"), "cell"), celled, degree + 1, metric, "cell")
        edges = stored(met.where("query_id <> item_id").select(F.col("query_id").alias("a"), F.col("item_id").alias("b"), "score", F.lit(True).alias("new")), "edges")
        best = Window.partitionBy("a").orderBy(F.round("score", PLACES).desc(), "b")
        for _ in range(rounds):
            admirers = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "new").withColumn("n", F.row_number().over(best)).where(F.col("n") <= degree).drop("n")
            around = edges.unionByName(admirers).groupBy("a", "b").agg(F.max("new").alias("new"))
            least = edges.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n"), F.min(F.round("score", PLACES)).alias("least")).where(F.col("n") >= degree).drop("n")
            told = x.withColumnRenamed("item_id", "b").join(least, "b", "left")
            both = _met(around.join(told, "b").repartition("a").sortWithinPartitions("a"), degree, metric)
            all_edges = edges.withColumn("new", F.lit(False)).unionByName(both.withColumn("new", F.lit(True)))
            merged = all_edges.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("new").alias("new"))
            edges = stored(merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= degree).drop("n"), "edges")
            if edges.where("new").count() <= least_change * max(1, n) * degree:
                break
        both_ways = edges.select("a", "b", "score").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).groupBy("a", "b").agg(F.max("score").alias("score"))
        kept = both_ways.withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * degree)
        kept.select(F.col("a").alias("item_id"), F.col("b").alias("neighbour")).write.parquet(f"{path}/edges")
        spark.createDataFrame([(metric, dim)], "metric string, dim int").coalesce(1).write.parquet(f"{path}/about")
        return NeighbourGraph(spark, path, metric, dim)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NeighbourGraph:
        about = spark.read.parquet(f"{path.rstrip('/')}/about").first()
        return NeighbourGraph(spark, path.rstrip("/"), about["metric"], about["dim"])

    @property
    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/items")

    def search(self, queries: DataFrame, k: int, *, candidates: int = 100, starts: int = 64, beam: int = 16, most_steps: int = 50, where: Column | None = None) -> DataFrame:
        """Hits of ``queries(query_id, query_vector)`` as ``dense_top_k`` gives them.

        Each query holds its ``candidates`` best vectors so far, and as many of
        those that pass ``where``, a condition on the stored columns. In each
        step it goes from the ``beam`` best of them that it hasn't left yet to
        their neighbours. It ends when it has left all that it holds. The walk
        goes through vectors that don't pass; queries that have found fewer than
        ``k`` that do are compared with all that do.
        """
        candidates = max(candidates, k)
        asked = stored(queries.select("query_id", "query_vector").where(F.size("query_vector") == self.dim), "asked")
        passes = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        items = self.items.withColumn("passes", passes).select("item_id", "vector", "passes")
        edges = self.spark.read.parquet(f"{self.path}/edges")
        entry = items.orderBy(F.xxhash64("item_id")).limit(starts).select("item_id", "vector")
        first = dense_top_k(asked, entry, beam, self.metric).select("query_id", "item_id", "score")
        held = first.join(items.select("item_id", "passes"), "item_id").select("query_id", "item_id", "score", "passes", F.lit(True).alias("open"))
        held = stored(held, "walk")
        places = Window.partitionBy("query_id", "passes").orderBy(F.round("score", PLACES).desc(), "item_id")
        turn = Window.partitionBy("query_id").orderBy(F.col("open").desc(), F.round("score", PLACES).desc(), "item_id")
        for _ in range(most_steps):
            ranked = held.withColumn("n", F.row_number().over(turn)).withColumn("leaves", F.col("open") & (F.col("n") <= beam))
            reached = ranked.where("leaves").select("query_id", "item_id").join(edges, "item_id").select("query_id", F.col("neighbour").alias("item_id")).distinct()
            new = reached.join(held, ["query_id", "item_id"], "left_anti").join(items, "item_id").join(asked, "query_id")
            scored = _pair_scores(new, self.metric, "query_vector", "vector").select("query_id", "item_id", "score", "passes", F.lit(True).alias("open"))
            rest = ranked.select("query_id", "item_id", "score", "passes", (F.col("open") & ~F.col("leaves")).alias("open"))
            held = stored(rest.unionByName(scored).withColumn("n", F.row_number().over(places)).where(F.col("n") <= candidates).drop("n"), "walk")
            if held.where("open").isEmpty():
                break
        more = [c for c in self.items.columns if c not in ("item_id", "vector")]
        found = top_k(held.where("passes").select("query_id", "item_id", "score"), k)
        enough = found.groupBy("query_id").count().where(F.col("count") >= k)
        short = asked.join(enough, "query_id", "left_anti")
        if not short.isEmpty():
            exact = dense_top_k(short, items.where("passes").select("item_id", "vector"), k, self.metric).select("query_id", "item_id", "score", "rank")
            found = found.join(enough.select("query_id"), "query_id").select("query_id", "item_id", "score", "rank").unionByName(exact)
        return found.join(self.items.select("item_id", *more), "item_id") if more else found.select("query_id", "item_id", "score", "rank")


def recall_at(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall)``: the share of the ``k`` exact best that were found; a found one with the score of the last counts as it."""
    least = exact.where(F.col("rank") <= k).groupBy("query_id").agg(F.min(F.round("score", PLACES)).alias("least"), F.count("*").alias("n"))
    good = found.where(F.col("rank") <= k).join(least, "query_id").where(F.round("score", PLACES) >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("good"))
    return least.join(good, "query_id", "left").select("query_id", (F.coalesce("good", F.lit(0)) / F.col("n")).alias("recall"))
