"""Retrieval over whole batches of queries: dense, BM25, fusion, routing, selection.

Every operator maps DataFrames to DataFrames. Hits are long tables
``(query_id, item_id, score, rank, ...)``; ties go by the item's identifier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_text, search_tokens
from lodestone.session import stored

#: Decimals that scores are compared with, so that orders don't hang on the order of additions.
PLACES = 9


def top_k(scored: DataFrame, k: int, by: str = "score", query: str = "query_id", *ties: str) -> DataFrame:
    """The first ``k`` rows of each query by falling ``by``; the limit is applied before the shuffle as well."""
    order = Window.partitionBy(query).orderBy(F.round(by, PLACES).desc(), *(ties or ("item_id",)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows of a list of hits that a task sorts, about.
MOST_HITS = 1_000_000


def by_query(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """``hits`` dealt by query, so that more of them make more tasks, not larger ones; they are counted."""
    least = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartition(max(least, -(-hits.count() // MOST_HITS)), query)


# ---- dense ----


#: Rows of a block of queries and of a block of vectors, and bytes of doubles that either may have.
QUERY_BLOCK, VECTOR_BLOCK, BLOCK_BYTES = 4096, 65_536, 64 << 20
#: Rows of a table of block counts that is broadcast; more are joined by a shuffle.
MOST_UNITS = 100_000


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix; null entries are NaN."""
    flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs of rows, the greater the better."""
    if metric == "l2":
        # sums of squared differences by dimension: a product of the vectors would lose digits
        out = np.zeros((len(q), len(v)))
        for k in range(q.shape[1]):
            out += (q[:, k, None] - v[None, :, k]) ** 2
        return -np.sqrt(out)
    made = q @ v.T
    if metric == "cosine":
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None]
        made = np.divide(made, norms, out=np.zeros_like(made), where=norms > 0)
    return made


#: Scores that a task holds at once.
MOST_SCORES = 1 << 19


def _first_of_each(row: np.ndarray, down: np.ndarray, score: np.ndarray, items: pa.Array, k: int):
    """Of candidates ``(row, -rounded score, score, item)`` the ``k`` first of each row; ties go by the item."""
    place = np.empty(len(items), np.int64)
    place[pc.sort_indices(items).to_numpy()] = np.arange(len(items))
    order = np.lexsort((place, down, row))
    row = row[order]
    begin = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    keep = np.arange(len(row)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] < k if len(row) else begin
    order = order[keep]
    return row[keep], down[order], score[order], items.take(pa.array(order))


def _block_top_k(k: int, metric: str, n_keys: int):
    """Of units of rows ``(keys, side, id, vector)`` in the order of keys and side, the ``k`` best vectors of each query of the unit.

    A unit's queries are held; its vectors pass batch by batch, so that a task's
    memory doesn't grow with the unit.
    """

    class Unit:
        def __init__(self):
            self.ids, self.held, self.q, self.best = [], [], None, None

        def ask(self, ids, column):
            self.ids.append(ids)
            self.held.append(column)

        def see(self, items, column):
            if not self.ids:
                return
            if self.q is None:
                self.ids, self.q, self.held = pa.concat_arrays(self.ids), np.concatenate([_matrix(h) for h in self.held]), []
                self.last = np.full(len(self.q), np.inf)  # what the k-th best of a query has so far
            v = _matrix(column)
            step = max(1, MOST_SCORES // len(v))
            found = []
            for lo in range(0, len(self.q), step):
                scores = _scores(self.q[lo : lo + step], v, metric)
                down = np.nan_to_num(scores, nan=-np.inf)
                np.round(down, PLACES, out=down)
                np.negative(down, out=down)
                most = self.last[lo : lo + step]
                if len(v) > k:  # all at least as good as the k-th
                    most = np.minimum(most, np.partition(down, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(down <= most[:, None])
                found.append((r + lo, down[r, c], scores[r, c], items.take(pa.array(c))))
                if sum(len(x[0]) for x in found) > MOST_SCORES:
                    self.merge(found)
                    found = []
            self.merge(found)

        def merge(self, found):
            if self.best is not None:
                found = [self.best, *found]
            if not found:
                return
            row, down, score = (np.concatenate([x[n] for x in found]) for n in range(3))
            self.best = _first_of_each(row, down, score, pa.concat_arrays([x[3] for x in found]), k)
            row, down = self.best[:2]
            n = np.bincount(row, minlength=len(self.q))
            full = np.flatnonzero(n >= k)
            self.last[full] = down[np.cumsum(n)[full] - 1]

        def made(self):
            if self.best is not None and len(self.best[0]):
                row, _, score, items = self.best
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), items, pa.array(score)], names=["query_id", "item_id", "score"])

    def run(batches):
        key, unit = None, Unit()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(n_keys)]
            change = np.zeros(batch.num_rows - 1, bool)
            for x in values:
                change |= x[1:] != x[:-1]
            cuts = np.flatnonzero(change) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = tuple(x[lo] for x in values)
                if now != key:
                    yield from unit.made()
                    key, unit = now, Unit()
                part = batch.slice(lo, hi - lo)
                own = part.column(n_keys)
                for side, put, name in ((0, unit.ask, n_keys + 1), (1, unit.see, n_keys + 2)):
                    if pc.any(pc.equal(own, side)).as_py():
                        mine = part.filter(pc.equal(own, side))
                        put(mine.column(name), mine.column(n_keys + 3))
        yield from unit.made()

    return run


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", within: str | list[str] | None = None) -> DataFrame:
    """The ``k`` best of ``vectors(item_id, vector, ...)`` for each of a stated set ``queries(query_id, query_vector, ...)``.

    Both sides are cut in blocks, and each pair of blocks is one matrix product
    that gives up all but the best of each query; pairs of rows never exist.
    ``within`` names columns of both sides that must be equal and not null; each
    of their values has blocks of its own, and vectors of values that no query
    has move nowhere. Only vectors of a query's length are compared with it:
    null and empty ones, and queries without a vector, have no hits. ``metric``
    is ``cosine`` (0 for zero vectors), ``dot`` or ``l2`` (negative distances, so
    that more is always better). Further columns of the vectors are joined to
    the hits.
    """
    named = [within] if isinstance(within, str) else list(within or ())
    values = [F.col(c).cast("string").alias(f"value{n}") for n, c in enumerate(named)]
    keys = [*(f"value{n}" for n in range(len(named))), "dim"]

    def side(rows: DataFrame, name: str, vector: str) -> DataFrame:
        made = rows.select(*values, name, F.col(vector).cast("array<double>").alias("x")).withColumn("dim", F.size("x")).where("dim > 0")
        return made.dropna(subset=keys)

    def cut(rows: DataFrame, most: int, name: str) -> DataFrame:
        fit = F.greatest(F.lit(1), F.least(F.lit(most), F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
        return rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / F.floor(fit)).cast("int").alias(name))

    asked, given = side(queries, "query_id", "query_vector"), side(vectors, "item_id", "vector")
    counts = stored(cut(asked, QUERY_BLOCK, "n_i").join(cut(given, VECTOR_BLOCK, "n_j"), keys), "blocks")
    if counts.count() <= MOST_UNITS:
        counts = F.broadcast(counts)  # counted
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    empty = {c: F.lit(None).cast(t.schema[c].dataType).alias(c) for t, c in ((queries, "query_id"), (vectors, "item_id"))}
    left = asked.join(counts, keys).select(*keys, block("query_id", "n_i").alias("i"), copies("n_j").alias("j"), F.lit(0).alias("side"), "query_id", empty["item_id"], "x")
    right = given.join(counts, keys).select(*keys, copies("n_i").alias("i"), block("item_id", "n_j").alias("j"), F.lit(1).alias("side"), empty["query_id"], "item_id", "x")
    unit = [*keys, "i", "j"]
    units = left.unionAll(right).repartition(*unit).sortWithinPartitions(*unit, "side")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {vectors.schema['item_id'].dataType.simpleString()}, score double"
    hits = top_k(units.mapInArrow(_block_top_k(k, metric, len(unit)), kinds), k)
    more = [c for c in vectors.columns if c not in ("item_id", "vector")]
    return hits.join(vectors.select("item_id", *more), "item_id") if more else hits


# ---- BM25 ----


@dataclass
class TextIndex:
    """An inverted index as DataFrames: ``postings(term, item_id, tf, dl)``, ``terms(term, df)``, ``totals(n, avgdl)`` of one row; ``found(item_id, dl, tokens)`` are the items that the postings are counted from."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    found: DataFrame
    only: DataFrame | None = None

    @staticmethod
    def build(items: DataFrame, item_id: str, text: str, tokens=search_tokens, only: DataFrame | None = None, most: int = 20_000) -> TextIndex:
        """``only(term)`` keeps just these terms' postings, with the same statistics: for a batch of queries, most tokens then never move.

        Up to ``most`` such terms, which are counted first, are looked up while
        the texts are cut: the texts are read once, and what is left of them is
        stored for all that reads the index. More terms are joined by a shuffle.
        """
        base = items.select(F.col(item_id).alias("item_id"), tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens").cast("bigint"))
        wanted = None if only is None else [r[0] for r in only.limit(most + 1).collect()]  # bounded
        if wanted is not None and len(wanted) <= most:
            # one expression as text: columns for thousands of literals take seconds to make
            listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in wanted)
            found = F.expr(f"filter(tokens, t -> t IN ({listed}))") if wanted else F.array().cast("array<string>")
            base = stored(base.select("item_id", "dl", found.alias("tokens")), "index")
        else:
            wanted = None
        totals = stored(base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "totals")
        made = TextIndex(None, None, totals, base, only if wanted is None else None)
        made.postings = made._counted(base)
        made.terms = stored(made.dealt().groupBy("term").agg(F.count("*").alias("df")), "terms")
        return made

    def _counted(self, items: DataFrame) -> DataFrame:
        rows = items.select("item_id", "dl", F.explode("tokens").alias("term"))
        if self.only is not None:
            rows = rows.join(self.only, "term", "left_semi")
        return rows.groupBy("item_id", "dl", "term").agg(F.count("*").alias("tf"))

    def dealt(self, n_queries: int = 0) -> DataFrame:
        """The postings, in as many parts by item as so many queries ask for; an item's tokens move, its postings don't."""
        return self._counted(by_item(self.found, "item_id", self.totals.first()["n"], n_queries))


def query_terms(queries: DataFrame, tokens=search_tokens) -> DataFrame:
    return queries.select(F.explode(tokens(F.col("question"))).alias("term")).distinct()


#: Pairs of an item and a query that a task scores at most, about; rows of a table of queries' terms that is broadcast, more are joined by a shuffle.
MOST_PAIRS, MOST_ASKED = 2_000_000, 200_000


def by_item(rows: DataFrame, column: str, n_items: int, n_queries: int) -> DataFrame:
    """``rows`` dealt by ``column``, so that a task scores about ``MOST_PAIRS`` pairs: all that is added up for an item then meets without another exchange."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-n_items * max(n_queries, 200) // MOST_PAIRS)), column)  # an item has postings, too


def small(rows: DataFrame, most: int = MOST_ASKED) -> DataFrame:
    """``rows``, which are stored, with the hint to broadcast them if they are few; they are counted."""
    return F.broadcast(rows) if rows.count() <= most else rows


def bm25_scores(queries: DataFrame, index: TextIndex, k1: float = 1.5, b: float = 0.75, tokens=search_tokens, among: DataFrame | None = None) -> DataFrame:
    """``(query_id, item_id, score)`` of items with a positive score, for ``queries(query_id, question)``.

    ``among(query_id, item_id)`` filters the hits; the statistics stay those of
    all items. Only postings of the queries' terms are read on. Postings are
    dealt by item and meet the queries' terms there, so that the scores of an
    item are added up where its postings are; pairs of items and queries don't
    move.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    weighed = asked.join(index.terms, "term").crossJoin(F.broadcast(index.totals))  # totals: one row
    weighed = stored(weighed.select("query_id", "term", "avgdl", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "weighed")
    tf = F.col("tf")
    part = F.col("idf") * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    n_queries = weighed.select("query_id").distinct().count()
    postings, condition = index.dealt(n_queries), F.lit(True)
    if among is not None:  # an item's queries, at most all, dealt as the items are
        own = by_item(among, "item_id", index.totals.first()["n"], n_queries).groupBy("item_id").agg(F.collect_set("query_id").alias("queries"))
        postings = postings.join(own, "item_id")
        condition = F.array_contains("queries", F.col("query_id"))
    met = postings.join(small(weighed), "term").where(condition)
    return met.groupBy("query_id", "item_id").agg(F.sum(part).alias("score")).where("score > 0")


def bm25_top_k(queries: DataFrame, index: TextIndex, k: int, **options) -> DataFrame:
    return top_k(bm25_scores(queries, index, **options), k)


# ---- fusion, deduplication, selection ----


def rrf_fuse(dense: DataFrame, bm25: DataFrame, k: int, rrf_k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs; ties go to what is seen first, the dense leg before the other. Blank items are skipped."""
    legs = None
    for n, (leg, weight) in enumerate(zip((dense, bm25), weights, strict=True)):
        part = leg.where(F.trim(F.col("item_id").cast("string")) != "").select(
            "query_id", "item_id", F.col("score"), F.col("rank").cast("bigint").alias("leg_rank"), F.lit(n).alias("leg"), (F.lit(weight) / (rrf_k + F.col("rank"))).alias("part")
        )
        legs = part if legs is None else legs.unionByName(part)
    fused = legs.groupBy("query_id", "item_id").agg(
        F.sum("part").alias("score"),
        F.max(F.when(F.col("leg") == 0, F.col("score"))).alias("dense_score"),
        F.max(F.when(F.col("leg") == 1, F.col("score"))).alias("bm25_score"),
        F.min(F.struct("leg", "leg_rank")).alias("seen"),
    )
    return top_k(fused, k, "score", "query_id", "seen", "item_id").drop("seen")


def dedupe_hits(hits: DataFrame, k: int, key: str | None) -> DataFrame:
    """The best-ranked hit of each ``key``, ranked anew; ``collapsed`` counts what was dropped for each query."""
    if key is None:
        return hits.where(F.col("rank") <= k).withColumn("collapsed", F.lit(0).cast("bigint"))
    first = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank", "item_id"))
    kept = hits.withColumn("first", first)
    kept = kept.withColumn("collapsed", F.sum((F.col("first") > 1).cast("bigint")).over(Window.partitionBy("query_id"))).where("first = 1").drop("first")
    order = Window.partitionBy("query_id").orderBy("rank", "item_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column, boost: Column | None = None) -> DataFrame:
    """New scores from a model (a column, built in or a pandas UDF) and a boost; ties by the earlier rank, then the item."""
    made = hits.withColumn("first_rank", F.col("rank")).withColumn("score", score + (boost if boost is not None else F.lit(0.0)))
    made = made.withColumn("score", F.when(F.isnan("score") | F.col("score").isNull(), F.raise_error(F.lit("a reranker's scores must be finite"))).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.round("score", PLACES).desc(), "first_rank", "item_id")
    return made.withColumn("rank", F.row_number().over(order))


def select_unique(ranked: DataFrame, k: int, rerank_top_k: int) -> DataFrame:
    """``k`` distinct items of the first ``rerank_top_k``; if these have fewer, the rest of the list fills up."""
    unique = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("rank"))).where("n = 1")
    unique = unique.withColumn("inside", F.col("rank") <= rerank_top_k)
    order = Window.partitionBy("query_id").orderBy(F.col("inside").desc(), "rank")
    return unique.withColumn("refilled", ~F.col("inside")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("n", "inside")


# ---- metadata ----


def metadata_boost(parts: dict[str, tuple[Column, float]]) -> Column:
    """Map of the boosts whose condition holds and whose weight isn't 0."""
    pairs = [F.when(F.coalesce(hit, F.lit(False)) & F.lit(w != 0), F.struct(F.lit(name).alias("key"), F.lit(float(w)).alias("value"))) for name, (hit, w) in parts.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def match_flags(signals: Column, value: Column) -> Column:
    """Null without a signal, else whether the value is among them."""
    return F.when(F.size(signals) > 0, F.coalesce(F.array_contains(signals, value), F.lit(False)))


def filter_or_all(hits: DataFrame, ok: Column) -> DataFrame:
    """Hits that pass; all of a query's hits, flagged, if none does."""
    any_ok = F.max(F.coalesce(ok, F.lit(False))).over(Window.partitionBy("query_id"))
    made = hits.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("filter_fallback", ~any_ok)
    return made.where("ok or filter_fallback").drop("ok")


def validate_category(predicted: DataFrame, categories: DataFrame) -> DataFrame:
    """``(query_id, category, validated, reason)``: an exact match, else one that ignores case and white space."""
    known = categories.select(F.trim("category").alias("known")).where("known <> ''").distinct()
    loose = known.groupBy(normalize_text(F.col("known")).alias("loose")).agg(F.min("known").alias("loose_match"))
    asked = predicted.withColumn("loose", normalize_text(F.col("predicted")))
    found = asked.join(known, F.col("predicted") == F.col("known"), "left").join(loose, "loose", "left")
    category = F.coalesce("known", "loose_match")
    reason = F.when(F.col("known").isNotNull(), "exact").when(F.col("loose_match").isNotNull(), "normalized").when(F.col("loose").isNull(), "category is empty").otherwise("category not found")
    return found.select("query_id", category.alias("category"), category.isNotNull().alias("validated"), reason.alias("reason"))


# ---- routing ----


def probe_support(probe: DataFrame, predicted: DataFrame) -> DataFrame:
    """Support of the predicted category among each query's probe hits ``(query_id, category, score)``, and its strongest competitor."""
    named = probe.withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("<missing>")))
    counts = named.groupBy("query_id", "category").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    joined = predicted.join(counts, "query_id", "left")
    own = F.col("category") == F.col("predicted")
    made = joined.groupBy("query_id", "predicted").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("predicted_count"),
        F.max(F.when(own, F.col("mean"))).alias("predicted_mean"),
        F.min(F.when(~own, F.struct((-F.col("n")).alias("n"), F.col("category")))).alias("rival"),
    )
    rival_count = F.coalesce(-F.col("rival.n"), F.lit(0)).cast("bigint")
    return made.select(
        "query_id", "predicted", F.col("total").cast("bigint").alias("total"), F.col("predicted_count").cast("bigint").alias("predicted_count"), "predicted_mean",
        F.when(F.col("total") > 0, F.col("predicted_count") / F.col("total")).otherwise(0.0).alias("share"),
        F.col("rival.category").alias("rival"), rival_count.alias("rival_count"), (F.col("predicted_count") - rival_count).cast("bigint").alias("margin"),
    )


def routing_decision(support: DataFrame, share: float, count: int, margin: int) -> DataFrame:
    failed = F.concat_ws(
        ",",
        F.when(F.col("share") < share, "category_share_below_threshold"),
        F.when(F.col("predicted_count") < count, "category_count_below_threshold"),
        F.when(F.col("margin") < margin, "support_margin_below_threshold"),
    )
    reason = F.when(F.col("total") == 0, "empty_global_probe").when(failed == "", "thresholds_satisfied").otherwise(failed)
    return support.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "thresholds_satisfied")


def category_or_global(category_hits: DataFrame, global_hits: DataFrame, routes: DataFrame, least: int = 1) -> DataFrame:
    """Category hits for routed queries that have ``least`` of them, global hits for the others.

    ``routes(query_id, routed)``. The result has ``retrieval_mode`` and
    ``fallback_reason`` (null where the category leg was used). The decisions
    are stored, so that the category leg isn't ranked again beside each leg.
    """
    n = category_hits.groupBy("query_id").agg(F.count("*").alias("n_category"))
    plan = routes.join(n, "query_id", "left").withColumn("n_category", F.coalesce("n_category", F.lit(0)))
    use = F.col("routed") & (F.col("n_category") >= least)
    reason = F.when(~F.col("routed"), "not_routed").when(F.col("n_category") == 0, "category_retrieval_empty").when(~use, "insufficient_category_results")
    plan = plan.select("query_id", F.when(use, "category").otherwise("global").alias("retrieval_mode"), reason.alias("fallback_reason"))
    plan = stored(plan, "routes")
    columns = ["query_id", "item_id", "score", "rank"]
    own = category_hits.select(*columns).join(plan.where("retrieval_mode = 'category'"), "query_id")
    return own.unionByName(global_hits.select(*columns).join(plan.where("retrieval_mode = 'global'"), "query_id"))


# ---- parents, budgets, parity ----


def within_budget(contexts: DataFrame, max_chars: int, max_words: int, query: str = "query_id") -> DataFrame:
    """Ranked contexts while their running sums fit; what comes after the first that doesn't is cut. Blank ones are skipped."""
    some = contexts.where(F.trim("text") != "").withColumns({"chars": F.length("text").cast("bigint"), "words": F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint")})
    run = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    over = (F.sum("chars").over(run) > max_chars) | (F.sum("words").over(run) > max_words)
    return some.withColumn("over", over).withColumn("cut", F.max("over").over(run)).where("not cut").drop("over", "cut")


def first_by_text(contexts: DataFrame, query: str = "query_id") -> DataFrame:
    """The first of contexts whose normalised texts are equal."""
    order = Window.partitionBy(query, normalize_text(F.col("text"))).orderBy("rank")
    return contexts.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def rankings_agree(reference: DataFrame, actual: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """For each query: whether both rankings have equal scores rank by rank, and equal sets in each group of ties but the last."""
    r = reference.select("query_id", "rank", F.col("item_id").alias("r_item"), F.col("score").alias("r_score"))
    a = actual.select("query_id", "rank", F.col("item_id").alias("a_item"), F.col("score").alias("a_score"))
    both = r.join(a, ["query_id", "rank"], "full_outer")
    same = F.coalesce(F.abs(F.col("r_score") - F.col("a_score")) <= tolerance, F.lit(False))
    both = both.withColumn("tie", F.round(F.coalesce("r_score", "a_score") / tolerance, 0)).withColumn("last", F.min("tie").over(Window.partitionBy("query_id")))
    groups = both.groupBy("query_id", "tie", "last").agg(F.min(same).alias("scores"), F.array_sort(F.collect_set("r_item")).alias("r"), F.array_sort(F.collect_set("a_item")).alias("a"))
    fine = F.col("scores") & ((F.col("tie") == F.col("last")) | (F.col("r") == F.col("a")))
    return groups.groupBy("query_id").agg(F.min(fine).alias("agree"))


def expand_parents(hits: DataFrame, max_words: int, limit: int) -> DataFrame:
    """Walk each query's hits by rank and give the parent sections of the first ``limit`` that are new.

    ``hits(query_id, rank, item_id, text, parents)``, ``parents`` an array of
    ``(parent_id, text, words)`` with the mapped one first: if that is too long,
    the first smaller one that fits is taken, and without any the child's text.
    The mapped parent is looked up among those already selected, so the walk is
    a fold over a query's few hits.
    """
    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "text", "parents"))).alias("hits"))
    start = F.from_json(F.lit('{"seen":[],"out":[]}'), "seen array<string>, out array<struct<item_id:string,parent_id:string,text:string,kind:string>>")

    def step(state: Column, hit: Column) -> Column:
        mapped = F.get(hit["parents"], F.lit(0))
        fit = F.get(F.filter(hit["parents"], lambda p: p["words"] <= max_words), F.lit(0))
        key = F.coalesce(fit["parent_id"], hit["item_id"].cast("string"))
        kind = F.when(fit.isNull(), "child").when(fit["parent_id"] == mapped["parent_id"], "parent").otherwise("smaller_parent")
        row = F.struct(hit["item_id"].cast("string").alias("item_id"), fit["parent_id"].alias("parent_id"), F.coalesce(fit["text"], hit["text"]).alias("text"), kind.alias("kind"))
        skip = (F.size(state["out"]) >= limit) | F.coalesce(F.array_contains(state["seen"], mapped["parent_id"]), F.lit(False))
        grown = F.struct(F.concat(state["seen"], F.array(key)).alias("seen"), F.concat(state["out"], F.array(row)).alias("out"))
        return F.when(skip, state).otherwise(grown)

    walked = ordered.select("query_id", F.aggregate("hits", start, step)["out"].alias("out"))
    return walked.select("query_id", F.posexplode("out").alias("at", "row")).select("query_id", (F.col("at") + 1).alias("rank"), "row.*")
