"""Registered queries of the retrieval-evaluation operators, each with the SQL that states the same.

Keys begin with the operator's identifier in the coverage list. Every query runs
over its whole tables; searches take as queries the rows whose id is divisible by 20.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import evaluation as E
from lodestone.operators import intervals as I
from lodestone.operators import leaderboard as L
from lodestone.operators import patterns as N
from lodestone.operators import retrieval as R
from lodestone.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LONG = "bigint"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- BM25 and fusion

_POSTINGS = r"""
    base AS MATERIALIZED (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens FROM documents),
    postings AS MATERIALIZED (SELECT doc_id, len(any_value(tokens)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM base) GROUP BY doc_id, term),
    terms AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term),
    totals AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM base),
    asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)"""


def _bm25_sql(name: str, k1: float, b: float) -> str:
    return f"""
    {name} AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * {k1 + 1}e0) / (tf + {k1}e0 * (1 - {b}e0 + {b}e0 * dl / avgdl))) AS score
        FROM asked JOIN terms USING (term) JOIN postings USING (term) CROSS JOIN totals GROUP BY item_id, doc_id)"""


def _index(spark, sf_dir) -> R.TextIndex:
    """What the passages' terms need of the documents' index."""
    return R.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", only=R.query_terms(_questions(spark, sf_dir)))


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _bm25(spark, sf_dir, k: int = 10, **options) -> DataFrame:
    return R.bm25_top_k(_questions(spark, sf_dir), _index(spark, sf_dir), k, **options)


def _named(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"), six("score").alias("score"), F.col("rank").cast(LONG).alias("rank"), *more)


@query(f"""
WITH {_POSTINGS}, {_bm25_sql('s', 1.5, 0.75)},
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
def rt06_bm25_topk(spark, sf_dir):
    return _named(_bm25(spark, sf_dir))


@query(f"""
WITH {_POSTINGS}, {_bm25_sql('s', 1.5, 0.75)},
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank
    FROM s JOIN base USING (doc_id) WHERE score > 0 AND source = 'src' || (item_id % 20))
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
def rt08_bm25_category(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    wanted = _questions(spark, sf_dir).select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("source"))
    return _named(_bm25(spark, sf_dir, among=wanted.join(docs, "source").select("query_id", "item_id")))


_LEGS = f"""
WITH {_POSTINGS}, {_bm25_sql('s1', 0.5, 0.1)}, {_bm25_sql('s2', 1.5, 0.75)},
l1 AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s1) WHERE rank <= 20),
l2 AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s2) WHERE rank <= 20)"""


@query(f"""{_LEGS},
fused AS (SELECT item_id, doc_id, coalesce(1 / (60 + l1.rank), 0) + coalesce(1 / (60 + l2.rank), 0) AS score, l1.rank AS r1, l2.rank AS r2 FROM l1 FULL JOIN l2 USING (item_id, doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, r1 IS NULL, coalesce(r1, r2), doc_id) AS rank FROM fused)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
def rt09_rrf(spark, sf_dir):
    q, index = _questions(spark, sf_dir), _index(spark, sf_dir)
    return _named(R.rrf_fuse(R.bm25_top_k(q, index, 20, k1=0.5, b=0.1), R.bm25_top_k(q, index, 20), 10))


@query(f"""
WITH {_POSTINGS}, {_bm25_sql('s', 1.5, 0.75)},
hits AS (SELECT * FROM (SELECT item_id, doc_id, source, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s JOIN base USING (doc_id)) WHERE rank <= 20),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS f, sum(0) OVER () FROM hits)),
counted AS (SELECT *, sum((f > 1)::INT) OVER (PARTITION BY item_id)::BIGINT AS collapsed FROM firsts),
ranked AS (SELECT item_id, doc_id, score, collapsed, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM counted WHERE f = 1)
SELECT item_id, doc_id, round(score, 6) AS score, rank, collapsed FROM ranked WHERE rank <= 5""")
def rt22_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    hits = _bm25(spark, sf_dir, 20).join(docs, "item_id")
    return _named(R.dedupe_hits(hits, 5, "source"), "collapsed")


@query(f"""
WITH {_POSTINGS}, {_bm25_sql('s', 1.5, 0.75)},
hits AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 20),
again AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score * (doc_id % 7 + 1), 9) DESC, rank, doc_id) AS r, score * (doc_id % 7 + 1) AS s2 FROM hits)
SELECT item_id, doc_id, round(s2, 6) AS score, r AS rank, r > 3 AS refilled FROM again WHERE r <= 5""")
def rt21_rerank_select(spark, sf_dir):
    hits = R.rerank(_bm25(spark, sf_dir, 20), F.col("score") * (F.col("item_id") % 7 + 1))
    return _named(R.select_unique(hits, 5, 3), "refilled")


@query(f"""
WITH {_POSTINGS}, {_bm25_sql('s', 1.5, 0.75)},
hits AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10),
gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
g AS (SELECT item_id, count(*) AS n FROM gold GROUP BY item_id),
marked AS (SELECT h.item_id, rank, (g.doc_id IS NOT NULL)::INT AS rel FROM hits h LEFT JOIN gold g USING (item_id, doc_id)),
per AS (SELECT b.item_id, k, coalesce(sum(rel) FILTER (rank <= k), 0) AS found, min(rank) FILTER (rank <= k AND rel = 1) AS first,
        coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg, any_value(g.n) AS n
    FROM benchmark b CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) LEFT JOIN marked m USING (item_id) LEFT JOIN g USING (item_id) GROUP BY b.item_id, k)
SELECT item_id, k::BIGINT AS k, (found > 0)::INT::DOUBLE AS hit, round(found / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr,
    round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM per""")
def mx01_ir_metrics(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("item_id", F.explode("at_k").alias("m")).select("item_id", "m.k", "m.hit", six("m.recall").alias("recall"), six("m.mrr").alias("mrr"), six("m.ndcg").alias("ndcg"))


def _evaluated(spark, sf_dir) -> DataFrame:
    """A row for each benchmark passage: the ranked documents, those that contain it, and metrics at 1, 3, 5 and 10."""
    hits = _bm25(spark, sf_dir).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda h: h["item_id"].cast("string")).alias("retrieved"))
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    met = N.containing(docs.select(F.col("doc_id").alias("text_id"), "text"), passages.select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")))
    gold = met.groupBy(F.col("passage_id").alias("query_id")).agg(F.collect_set(F.col("text_id").cast("string")).alias("gold"))
    rows = passages.select(F.col("item_id").alias("query_id")).join(hits, "query_id", "left").join(gold, "query_id", "left")
    at = [F.struct(F.lit(k).cast(LONG).alias("k"), *[c.alias(n) for n, c in M.rank_metrics(F.col("retrieved"), F.col("gold"), k).items()]) for k in (1, 3, 5, 10)]
    return rows.select(F.col("query_id").alias("item_id"), "retrieved", "gold", F.array(*at).alias("at_k"))


def mean_metrics(spark, sf_dir) -> DataFrame:
    """The whole evaluation: search, judge, and average over the passages, nulls left out."""
    rows = _evaluated(spark, sf_dir).select(F.explode("at_k").alias("m")).select("m.*")
    return rows.groupBy("k").agg(F.count("*").alias("n"), *[six(F.avg(m)).alias(f"mean_{m}") for m in ("hit", "recall", "mrr", "precision", "ndcg")]).orderBy("k")


@query("""
WITH x AS (SELECT doc_id, list_transform([0, 3, 1, 3, 2], lambda i: ((doc_id + i) % 7)::VARCHAR) AS r, list_transform(range(doc_id % 4), lambda i: ((doc_id * 3 + i) % 9)::VARCHAR) AS g FROM documents),
y AS (SELECT doc_id, r[1:3] AS t, list_distinct(g) AS g FROM x),
z AS (SELECT doc_id, g, t, list_filter([1, 2, 3], lambda i: list_contains(g, t[i]) AND list_position(t, t[i]) = i) AS hits FROM y)
SELECT doc_id, (len(hits) > 0)::INT::DOUBLE AS hit, round(CASE WHEN len(g) > 0 THEN len(hits) / len(g) ELSE 0 END, 6) AS recall,
    round(coalesce(1 / list_min(hits), 0), 6) AS mrr, round(CASE WHEN len(g) > 0 THEN coalesce(list_sum(list_transform(hits, lambda i: 1 / log2(i + 1))), 0) / list_sum(list_transform(range(1, least(len(g), 3) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM z""")
def mx05_chunk_metrics(spark, sf_dir):
    retrieved = F.transform(F.array(*map(F.lit, (0, 3, 1, 3, 2))), lambda i: ((F.col("doc_id") + i) % 7).cast("string"))
    n = (F.col("doc_id") % 4).cast("int")
    gold = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((F.col("doc_id") * 3 + i) % 9).cast("string"))).otherwise(F.array().cast("array<string>"))
    made = M.chunk_metrics(F.col("retrieved"), F.col("gold"), 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", retrieved.alias("retrieved"), gold.alias("gold"))
    return rows.select("doc_id", made["hit"].alias("hit"), *[six(made[m]).alias(m) for m in ("recall", "mrr", "ndcg")])


# ---------------------------------------------------------------- dense retrieval and routing

_DENSE = """
WITH q AS (SELECT vec_id AS query_id, embedding AS e, label AS predicted FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, predicted, vec_id AS item_id, label, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM q CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS crank FROM s WHERE label = predicted)"""


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category"))
    q = v.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("category").alias("predicted"))
    return q, v


@query(f"{_DENSE} SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def rt01_dense_topk(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return R.dense_top_k(q.drop("predicted"), v, 5).select("query_id", "item_id", six("score").alias("score"), F.col("rank").cast(LONG).alias("rank"))


@query(f"{_DENSE} SELECT query_id, item_id, round(score, 6) AS score, crank AS rank FROM c WHERE crank <= 5")
def rt12_category_dense(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return R.dense_top_k(q.withColumnRenamed("predicted", "category"), v, 5, within="category").select("query_id", "item_id", six("score").alias("score"), F.col("rank").cast(LONG).alias("rank"))


_PROBE = f"""{_DENSE},
n AS (SELECT query_id, predicted, label, count(*) AS n FROM r WHERE rank <= 20 GROUP BY ALL),
p AS (SELECT query_id, any_value(predicted) AS predicted, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (label = predicted), 0)::BIGINT AS predicted_count,
      coalesce(max(n) FILTER (label <> predicted), 0) AS rival_count FROM n GROUP BY query_id),
d AS (SELECT query_id, predicted::VARCHAR AS predicted, total, predicted_count, round(predicted_count / total, 6) AS share, rival_count, predicted_count - rival_count AS margin,
      concat_ws(',', CASE WHEN predicted_count / total < 0.15 THEN 'category_share_below_threshold' END, CASE WHEN predicted_count < 3 THEN 'category_count_below_threshold' END, CASE WHEN predicted_count - rival_count < 0 THEN 'support_margin_below_threshold' END) AS failed FROM p),
routes AS (SELECT * EXCLUDE (failed), CASE WHEN failed = '' THEN 'thresholds_satisfied' ELSE failed END AS reason, failed = '' AS accepted FROM d)"""


def _routes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The global probe, made once for all that reads it, and the decisions on it."""
    q, v = _vectors(spark, sf_dir)
    probe = stored(R.dense_top_k(q.drop("predicted"), v, 20), "probe")
    return probe, R.routing_decision(R.probe_support(probe, q.select("query_id", "predicted")), 0.15, 3, 0)


@query(f"{_PROBE} SELECT * FROM routes")
def rt15_probe_routing(spark, sf_dir):
    return _routes(spark, sf_dir)[1].select("query_id", "predicted", "total", "predicted_count", six("share").alias("share"), "rival_count", "margin", "reason", "accepted")


@query(f"""{_PROBE}
SELECT query_id, item_id, round(score, 6) AS score, crank AS rank, 'category' AS retrieval_mode, NULL::VARCHAR AS fallback_reason FROM c JOIN routes USING (query_id) WHERE accepted AND crank <= 5
UNION ALL SELECT query_id, item_id, round(score, 6), rank, 'global', 'not_routed' FROM r JOIN routes USING (query_id) WHERE NOT accepted AND rank <= 5""")
def rt17_adaptive_routing(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    probe, routes = _routes(spark, sf_dir)
    routes = routes.select("query_id", F.col("accepted").alias("routed"))
    own = R.dense_top_k(q.withColumnRenamed("predicted", "category"), v, 5, within="category")
    out = R.category_or_global(own, probe.where("rank <= 5"), routes)
    return out.select("query_id", "item_id", six("score").alias("score"), F.col("rank").cast(LONG).alias("rank"), "retrieval_mode", "fallback_reason")


@query(f"""{_DENSE}, h AS (SELECT query_id, item_id, score, rank, (label % 3 = query_id % 3) AS ok FROM r WHERE rank <= 5),
f AS (SELECT *, NOT bool_or(ok) OVER (PARTITION BY query_id) AS filter_fallback FROM h)
SELECT query_id, item_id, rank, filter_fallback FROM f WHERE ok OR filter_fallback""")
def pr05_filter_fallback(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    hits = R.dense_top_k(q.drop("predicted"), v, 5)
    return R.filter_or_all(hits, F.col("category").cast("int") % 3 == F.col("query_id") % 3).select("query_id", "item_id", F.col("rank").cast(LONG).alias("rank"), "filter_fallback")


def _ranked_sql(name: str, vector: str) -> str:
    cosine = f"list_dot_product(q.{vector}, v.{vector}) / (sqrt(list_dot_product(q.{vector}, q.{vector})) * sqrt(list_dot_product(v.{vector}, v.{vector})))"
    return f"{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {cosine} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine}, 9) DESC, v.vec_id) AS rank FROM v AS q CROSS JOIN v WHERE q.vec_id % 20 = 0) WHERE rank <= 5)"


@query(f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding, lambda c: floor(c::DOUBLE * 16) / 16 + 0.03125e0) AS y FROM embeddings), {_ranked_sql('r', 'x')}, {_ranked_sql('a', 'y')},
j AS (SELECT query_id, rank, r.item_id AS ri, a.item_id AS ai, r.score AS rs, a.score AS s, round(r.score / 0.01e0, 0) AS tie, min(round(r.score / 0.01e0, 0)) OVER (PARTITION BY query_id) AS last FROM r JOIN a USING (query_id, rank)),
g AS (SELECT query_id, tie, last, bool_and(abs(rs - s) <= 0.01e0) AS close, list_sort(list(DISTINCT ri)) = list_sort(list(DISTINCT ai)) AS same FROM j GROUP BY query_id, tie, last)
SELECT query_id, bool_and(close AND (tie = last OR same)) AS agree FROM g GROUP BY query_id""")
def rt26_backend_parity(spark, sf_dir):
    """Exact vectors against vectors in steps of a sixteenth: which queries still have the same ranking."""
    q, v = _vectors(spark, sf_dir)
    steps = lambda c: F.transform(c, lambda x: F.floor(x.cast("double") * 16) / 16 + 0.03125)
    coarse = R.dense_top_k(q.select("query_id", steps("query_vector").alias("query_vector")), v.select("item_id", steps("vector").alias("vector")), 5)
    return R.rankings_agree(R.dense_top_k(q.drop("predicted"), v.drop("category"), 5), coarse, 0.01)


@query("""
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def mx09_cosine(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", six(M.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


# ---------------------------------------------------------------- chunking

@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(CASE WHEN len(words) = 0 THEN 0 WHEN len(words) <= 50 THEN 1 ELSE 1 + ceil((len(words) - 50) / 40)::BIGINT END)) AS ordinal FROM w)
SELECT doc_id, ordinal, ordinal * 40 AS start, least(ordinal * 40 + 50, len(words)) AS "end", sha256(array_to_string(words[ordinal * 40 + 1:ordinal * 40 + 50], ' ')) AS digest FROM s""")
def ch01_fixed_word(spark, sf_dir):
    rows = C.word_windows(table(spark, sf_dir, "documents"), 50, 10)
    return rows.select("doc_id", *[F.col(c).cast(LONG).alias(c) for c in ("ordinal", "start", "end")], F.sha2("text", 256).alias("digest"))


_ABBREVIATED = ", ".join(f"'{a}'" for a in sorted(C.ABBREVIATIONS))


@query(rf"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM documents)
SELECT doc_id, len(pieces) - len(list_filter(pieces[1:len(pieces) - 1], lambda x: lower(regexp_extract(x, '[^ ]*$')) IN ({_ABBREVIATED}))) AS n_sentences FROM p WHERE trim(array_to_string(pieces, '')) <> ''""")
def ch03_sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(C.sentence_array(F.col("text"))).cast(LONG).alias("n_sentences"))


@query(rf"""
WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM documents),
j AS (SELECT doc_id, list_reduce(pieces, lambda done, next: CASE WHEN lower(regexp_extract(done, '[^ ' || chr(2) || ']*$')) IN ({_ABBREVIATED}) THEN done || ' ' || next ELSE done || chr(2) || next END) AS joined FROM p WHERE trim(array_to_string(pieces, '')) <> ''),
s AS (SELECT doc_id, string_split(joined, chr(2)) AS sentences FROM j),
c AS (SELECT *, len(sentences) AS n, list_transform(range(0, len(sentences) + 1), lambda i: coalesce(list_sum(list_transform(sentences[1:i], lambda x: len(string_split(x, ' ')))), 0)) AS words FROM s),
walk AS (
    SELECT doc_id, 0 AS ordinal, 0::BIGINT AS start, greatest(1, list_max(list_filter(range(1, n + 1), lambda e: words[e + 1] <= 128))) AS "end", sentences, n, words FROM c
    UNION ALL
    SELECT doc_id, ordinal, begins, greatest(begins + 1, list_max(list_filter(range(begins + 1, n + 1), lambda e: words[e + 1] - words[begins + 1] <= 128))), sentences, n, words
    FROM (SELECT doc_id, ordinal + 1 AS ordinal, "end" - least(2, "end" - start - 1) AS begins, sentences, n, words FROM walk WHERE "end" < n))
SELECT doc_id, ordinal::BIGINT AS ordinal, start, "end"::BIGINT AS "end", sha256(array_to_string(sentences[start + 1:"end"], ' ')) AS digest, CASE WHEN n > 1 THEN 'sentence' ELSE 'sentence_fallback' END AS kind, words["end" + 1] - words[start + 1] > 128 AS oversized FROM walk""")
def ch04_sentence_chunks(spark, sf_dir):
    rows = C.chunk_documents(table(spark, sf_dir, "documents"), lambda t: C.sentence_chunks(t, 128, 2))
    return rows.select("doc_id", F.col("ordinal").cast(LONG).alias("ordinal"), "start", "end", F.sha2("text", 256).alias("digest"), "kind", "oversized")


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?;:]\s+|\n\n)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS pieces FROM documents),
b AS (SELECT doc_id, text, list_transform(range(1, len(pieces) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT) AS ends FROM p WHERE len(pieces) > 0),
walk AS (
    SELECT doc_id, 0 AS ordinal, 0::BIGINT AS start, coalesce(list_max(list_filter(ends, lambda e: e <= 512)), ends[1]) AS stop, text, ends FROM b
    UNION ALL SELECT doc_id, ordinal + 1, stop, coalesce(list_max(list_filter(ends, lambda e: e > stop AND e <= stop + 512)), list_min(list_filter(ends, lambda e: e > stop))), text, ends FROM walk WHERE stop < length(text))
SELECT doc_id, ordinal::BIGINT AS ordinal, start, stop AS "end", sha256(text[start + 1:stop]) AS digest, stop - start > 512 AS oversized FROM walk""")
def ch06_lossless_chunks(spark, sf_dir):
    """Where the text is cut: after sentences and clauses, as late as fits."""
    rows = C.chunk_documents(table(spark, sf_dir, "documents"), lambda t: C.lossless_chunks(t, 512))
    return rows.select("doc_id", F.col("ordinal").cast(LONG).alias("ordinal"), "start", "end", F.sha2("text", 256).alias("digest"), "oversized")


@query()
def ch07_table_chunks(spark, sf_dir):
    return C.chunk_documents(table(spark, sf_dir, "documents"), lambda t: C.table_chunks(t, 256, 40, 4000, 600))


@query(r"""
WITH t AS (SELECT doc_id, '# ' || source || chr(10) || text || chr(10) || '## a' || chr(10) || text AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
h AS (SELECT doc_id, start, length(regexp_extract(line, '^(#{1,6})[ \t]+.+$', 1)) AS level, length(text) AS n FROM o WHERE regexp_matches(line, '^#{1,6}[ \t]+.+$'))
SELECT doc_id, start, coalesce((SELECT min(g.start) FROM h g WHERE g.doc_id = h.doc_id AND g.start > h.start AND g.level <= h.level), n) AS "end", level::BIGINT AS level FROM h""")
def ch14_markdown_sections(spark, sf_dir):
    """Every document twice, under two headings: whatever headings it has itself are sections too."""
    made = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n## a\n"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", made.alias("text"))
    return C.markdown_sections(docs).select("doc_id", "start", "end", F.col("level").cast(LONG).alias("level"))


@query(r"""
WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, length(text) AS chars FROM documents)
SELECT count(*) AS total, count(*) FILTER (chars = 0) AS empty, count(*) FILTER (chars > 2048) AS over_chars, count(*) FILTER (words > 400) AS over_words, max(chars) AS max_chars, max(words) AS max_words FROM w""")
def ch12_chunk_diagnostics(spark, sf_dir):
    return C.chunk_diagnostics(table(spark, sf_dir, "documents"), 2048, 400)


_CHUNKS = """
c AS (SELECT doc_id, i AS item_id, i * 800 AS start, least(i * 800 + 1000, n_chars) AS "end" FROM documents, unnest(range((n_chars + 799) // 800)) AS u(i)),"""


def _char_chunks(docs: DataFrame) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0).cast(LONG), F.floor((F.col("n_chars") + 799) / 800) - 1))
    return docs.where("n_chars > 0").select("doc_id", "n_chars", i.alias("item_id")).select("doc_id", "item_id", (F.col("item_id") * 800).alias("start"), F.least(F.col("item_id") * 800 + 1000, F.col("n_chars")).alias("end"))


@query(f"""
WITH {_CHUNKS} s AS (SELECT doc_id AS span_id, doc_id, n_chars // 4 AS s_start, n_chars // 2 + 1 AS s_end FROM documents),
o AS (SELECT span_id, item_id, least(s_end, "end") - greatest(s_start, start) AS overlap, s_end - s_start AS sl, "end" - start AS cl FROM s JOIN c USING (doc_id) WHERE s_start < "end" AND start < s_end),
r AS (SELECT span_id, item_id, overlap, round(overlap / sl, 6) AS evidence_coverage, round(overlap / cl, 6) AS chunk_coverage FROM o)
SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY overlap DESC, evidence_coverage DESC, item_id) = 1 AS is_primary FROM r""")
def rt25_span_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spans = docs.select(F.col("doc_id").alias("span_id"), "doc_id", F.floor(F.col("n_chars") / 4).alias("s_start"), (F.floor(F.col("n_chars") / 2) + 1).alias("s_end"))
    return I.span_overlaps(spans, _char_chunks(docs)).select("span_id", "item_id", "overlap", "evidence_coverage", "chunk_coverage", "is_primary")


@query(f"""
WITH {_CHUNKS}
s AS (SELECT doc_id, 'top' AS parent_id, 0 AS s_start, n_chars // 3 * 3 AS s_end, 1 AS level, 0 AS ordinal FROM documents
      UNION ALL SELECT doc_id, 'part' || i, i * (n_chars // 3), (i + 1) * (n_chars // 3), 2, 1 + i FROM documents, range(3) AS r(i)),
m AS (SELECT doc_id, item_id, parent_id, level, ordinal, s_end - s_start AS span, greatest(0, least("end", s_end) - greatest(start, s_start)) AS overlap, s_start <= start AND s_end >= "end" AS inside FROM c JOIN s USING (doc_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY inside DESC, CASE WHEN inside THEN -level ELSE -overlap END, CASE WHEN inside THEN span ELSE -level END, ordinal) AS n FROM m)
SELECT doc_id, item_id, CASE WHEN inside OR overlap > 0 THEN parent_id END AS parent_id, CASE WHEN inside THEN 'contained' WHEN overlap > 0 THEN 'overlap' ELSE 'fallback' END AS mapping FROM b WHERE n = 1""")
def rt24_parent_mapping(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    third = F.floor(F.col("n_chars") / 3)
    top = docs.select("doc_id", F.lit("top").alias("parent_id"), F.lit(0).cast(LONG).alias("s_start"), (third * 3).alias("s_end"), F.lit(1).alias("level"), F.lit(0).alias("ordinal"))
    parts = docs.select("doc_id", third.alias("t"), F.explode(F.array(*map(F.lit, range(3)))).alias("i")).select("doc_id", F.concat(F.lit("part"), "i").alias("parent_id"), (F.col("i") * F.col("t")).alias("s_start"), ((F.col("i") + 1) * F.col("t")).alias("s_end"), F.lit(2).alias("level"), (F.col("i") + 1).alias("ordinal"))
    return I.map_to_parents(_char_chunks(docs), top.unionByName(parts))


# ---------------------------------------------------------------- answers, contexts

@query(r"""
WITH n AS (SELECT conv_id, turn, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations)
SELECT conv_id, turn, t <> '' AS non_empty, trim(t, ' .!?:;') IN ('unknown', 'not found', 'n/a', 'na', 'unbekannt', 'keine angabe', 'k.a') OR t = '' AS abstained, length(t) AS n_chars FROM n""")
def mx06_answer_flags(spark, sf_dir):
    plain = F.lower(T.collapse(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (plain != "").alias("non_empty"), T.is_abstention(F.col("text")).alias("abstained"), F.length(plain).cast(LONG).alias("n_chars"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    answers = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(answers, ["conv_id", "turn"])


@query(f"""
WITH t AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-ZäöüßÄÖÜ0-9]+')), lambda w: w NOT IN ({_STOP})) AS w FROM conversations),
p AS (SELECT q.conv_id, q.turn, q.w AS q, a.w AS a FROM t q JOIN t a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 OR len(a) = 0 THEN 0 ELSE 2 * len(list_intersect(q, a)) / (len(q) + len(a)) END, 6) AS f1 FROM p""")
def mx07_lexical_f1(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", six(T.lexical_f1(F.col("text"), F.col("answer"))).alias("f1"))


@query(r"""
WITH c AS (SELECT conv_id, turn, text, length(text) AS chars, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words FROM conversations WHERE trim(text) <> ''),
o AS (SELECT *, sum(chars) OVER w > 1500 OR sum(words) OVER w > 250 AS over FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, bool_or(over) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cut FROM o)
SELECT conv_id, turn, chars, words FROM k WHERE NOT cut""")
def wn04_context_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("rank", F.col("turn"))
    return R.within_budget(rows, 1500, 250, "conv_id").select("conv_id", "turn", "chars", "words")


@query(r"""
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') ORDER BY turn) AS n FROM conversations) WHERE n = 1""")
def wn05_prompt_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("rank", F.col("turn"))
    return R.first_by_text(rows, "conv_id").select("conv_id", "turn")


@query()
def mx08_hash_embedding(spark, sf_dir):
    from lodestone.functions.models import hash_embedding

    return table(spark, sf_dir, "benchmark").select("item_id", hash_embedding(256)("text").alias("embedding"))


# ---------------------------------------------------------------- queries' metadata and identifiers

@query(r"""
WITH q AS (SELECT event_id, 'Q' || (event_id % 5) || ' revenue of fy ' || year(ts) || ' and ' || (1925 + event_id % 110) || ' in ' || monthname(ts) AS t FROM events)
SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b(?:19[3-9]\d|20[0-2]\d|2030)\b'))), ',') AS years,
    array_to_string(regexp_extract_all(lower(t), '\bfy\s*(\d{4})\b', 1), ',') AS fiscal_years,
    month(strptime(regexp_extract(t, '[A-Za-z]+$'), '%B'))::VARCHAR AS months, array_to_string(regexp_extract_all(lower(t), '\bq[1-4]\b'), ',') AS quarters FROM q""")
def pr01_query_metadata(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"))), F.month("ts"))
    t = F.concat(F.lit("Q"), F.col("event_id") % 5, F.lit(" revenue of fy "), F.year("ts"), F.lit(" and "), 1925 + F.col("event_id") % 110, F.lit(" in "), names)
    rows = table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    parts = {"years": T.query_years, "fiscal_years": T.query_fiscal_years, "months": T.query_months, "quarters": T.query_quarters}
    return rows.select("event_id", *[F.array_join(f(F.col("t")).cast("array<string>"), ",").alias(n) for n, f in parts.items()])


@query(r"""
SELECT page_id, lower(regexp_replace(regexp_extract(rtrim(replace(url, '\', '/'), '/'), '[^/]*$') || CASE page_id % 3 WHEN 0 THEN '.txt_chunk_7' WHEN 1 THEN '.MD#chunk=2' ELSE '' END, '(?i)(\.txt|\.md)(_chunk_|::chunk_|#chunk=).*$', '\1')) AS source_id FROM pages""")
def pr08_source_id(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, ".txt_chunk_7").when(F.col("page_id") % 3 == 1, ".MD#chunk=2").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", T.source_id(F.concat(F.regexp_replace("url", "/+$", ""), tail)).alias("source_id"))


@query("""
WITH k AS (SELECT DISTINCT source AS known FROM documents), p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'src' || event_id % 25 WHEN 1 THEN ' SRC' || event_id % 25 || ' ' WHEN 2 THEN '' END AS predicted FROM events)
SELECT event_id AS query_id, k.known AS category, k.known IS NOT NULL AS validated, CASE WHEN k.known = predicted THEN 'exact' WHEN k.known IS NOT NULL THEN 'normalized' WHEN coalesce(trim(predicted), '') = '' THEN 'category is empty' ELSE 'category not found' END AS reason
FROM p LEFT JOIN k ON k.known = lower(trim(predicted))""")
def pr06_validate_category(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.col("source").alias("category"))
    n, i = F.concat(F.lit("src"), F.col("event_id") % 25), F.col("event_id") % 4
    predicted = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.when(i == 0, n).when(i == 1, F.concat(F.lit(" "), F.upper(n), F.lit(" "))).when(i == 2, "").alias("predicted"))
    return R.validate_category(predicted, known)


@query("""
SELECT o_orderkey AS query_id, array_to_string(list_sort(list(DISTINCT lower(n_name)) FILTER (n_name IS NOT NULL)), ',') AS mentioned
FROM (SELECT o_orderkey, 'report on ' || n_name || ' of ' || o_orderdate AS q FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) LEFT JOIN nation ON contains(lower(q), lower(n_name)) GROUP BY o_orderkey""")
def pr02_mentioned_values(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    q = orders.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("report on "), "n_name", F.lit(" of "), F.col("o_orderdate").cast("string")).alias("question"))
    return N.mentioned_values(q, nation.select(F.col("n_name").alias("value"))).withColumn("mentioned", F.array_join("mentioned", ","))


# ---------------------------------------------------------------- result rows: reasons, latency, reconciliation

@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'no_category_detected' WHEN event_id % 3 = 0 THEN CASE event_id % 5 WHEN 0 THEN 'no_category_detected' WHEN 1 THEN 'invalid_category' WHEN 2 THEN 'no_category_detected' ELSE 'other' END
    WHEN event_id % 7 < 5 THEN 'insufficient_category_results' ELSE 'other' END AS reason FROM events""")
def mx15_fallback_reason(spark, sf_dir):
    i = F.col("event_id")
    said = F.when(i % 5 == 0, "category is empty").when(i % 5 == 1, "Category Not Found").when(i % 5 == 2, "call failed")
    reason = M.fallback_reason(i % 2 != 0, F.when(i % 11 == 0, "boom"), i % 3 != 0, said, i % 7, F.lit(5))
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS p, CASE WHEN event_id % 5 = 0 THEN value * 2 END AS r, CASE WHEN event_id % 2 = 0 THEN 5e0 END AS t, CASE WHEN event_id % 7 = 0 THEN 1e0 END AS k, CASE WHEN event_id % 4 = 0 THEN value + 1 END AS g FROM events)
SELECT event_id, round(coalesce(CASE WHEN p IS NOT NULL THEN p + coalesce(g, 0) WHEN r IS NOT NULL THEN r + coalesce(k, 0) + coalesce(g, 0) WHEN coalesce(t, k, g) IS NOT NULL THEN coalesce(t, 0) + coalesce(k, 0) + coalesce(g, 0) END, 99), 6) AS latency FROM e""")
def mx16_latency(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    parts = [F.when(i % 3 == 0, v), F.when(i % 5 == 0, v * 2), F.when(i % 2 == 0, F.lit(5.0)), F.when(i % 7 == 0, F.lit(1.0)), F.when(i % 4 == 0, v + 1)]
    return table(spark, sf_dir, "events").select("event_id", six(M.retrieval_generation_latency(*parts, F.lit(99.0))).alias("latency"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error' AND value > 10) WHERE n = 1""")
def sk02_reconcile(spark, sf_dir):
    rows = E.reconcile(table(spark, sf_dir, "events"), "user_id", "event_id", (F.col("event_type") != "error") & (F.col("value") > 10))
    return rows.select("user_id", "event_id", "event_type")


@query("SELECT event_type, user_id, n, rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS rank FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)")
def wn02_competition_rank(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return L.competition_rank(counts, "n", ["event_type"])


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN rank() OVER (PARTITION BY c_nationkey, c_acctbal > 0 ORDER BY c_acctbal DESC) END AS rank FROM customer")
def wn03_group_rank(spark, sf_dir):
    return L.competition_rank(table(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"], F.col("c_acctbal") > 0).select("c_custkey", "c_nationkey", "rank")


# ---------------------------------------------------------------- scores of experiments

_RUN = "SELECT s_suppkey, (s_suppkey % 97) / 96e0 AS a, (s_suppkey % 89) / 88e0 AS b, (s_suppkey % 83) / 82e0 AS c, (s_suppkey % 6)::DOUBLE AS j1, (s_suppkey % 5)::DOUBLE AS j2, (s_suppkey % 4)::DOUBLE AS j3 FROM supplier"


def _runs(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (k % 97 / 96.0).alias("a"), (k % 89 / 88.0).alias("b"), (k % 83 / 82.0).alias("c"), *[(k % m).cast("double").alias(f"j{n}") for n, m in ((1, 6), (2, 5), (3, 4))])


@query(f"SELECT s_suppkey, round(0.6e0 * a + 0.25e0 * b + 0.15e0 * c, 6) AS score FROM ({_RUN})")
def mx17_retrieval_score(spark, sf_dir):
    return _runs(spark, sf_dir).select("s_suppkey", six(M.retrieval_score(F.col("a"), F.col("b"), F.col("c"))).alias("score"))


@query(f"""SELECT s_suppkey, round(0.3e0 * (0.6e0 * a + 0.25e0 * b + 0.15e0 * c) + 0.2e0 * (0.5e0 * b + 0.5e0 * c) + 0.25e0 * (0.5e0 * a + 0.5e0 * j1 / 5) + 0.25e0 * (0.4e0 * j1 / 5 + 0.3e0 * j2 / 5 + 0.3e0 * j3 / 5), 6) AS rqi FROM ({_RUN})""")
def mx18_quality_index(spark, sf_dir):
    a, b, c, j1, j2, j3 = (F.col(x) for x in ("a", "b", "c", "j1", "j2", "j3"))
    score = M.quality_index(M.retrieval_score(a, b, c), M.answer_quality(b, c), M.faithfulness(a, j1), M.generation_quality(j1, j2, j3))
    return _runs(spark, sf_dir).select("s_suppkey", six(score).alias("rqi"))


@query(f"SELECT s_suppkey, round(5 * (0.3e0 * (j1 / 5) + 0.25e0 * (j2 / 5) + 0.2e0 * (j3 / 5) + 0.15e0 * ((5 - j2) / 5) + 0.1e0 * (j1 / 5)), 4) AS overall FROM ({_RUN})")
def mx19_judge_overall(spark, sf_dir):
    j1, j2, j3 = F.col("j1"), F.col("j2"), F.col("j3")
    return _runs(spark, sf_dir).select("s_suppkey", M.judge_overall(j1, j2, j3, j2, j1).alias("overall"))


@query("""
WITH r AS (SELECT s_suppkey AS k, 96 AS e, CASE WHEN s_suppkey % 13 = 0 THEN 95 ELSE 96 END AS n, s_suppkey % 9 <> 0 AS manifest, CASE WHEN s_suppkey % 8 = 0 THEN 'invalid' ELSE 'valid' END AS v, s_suppkey % 7 <> 0 AS strict, s_suppkey % 29 = 0 AS fake, s_suppkey % 31 <> 0 AS outs, s_suppkey % 37 = 0 AS dup, s_suppkey % 5 <> 0 AS valid, (s_suppkey % 10) / 100e0 AS rate FROM supplier),
x AS (SELECT k, list_filter([CASE WHEN NOT manifest THEN 'manifest_missing' END, CASE WHEN v <> 'valid' THEN 'final_verdict_invalid' END, CASE WHEN NOT strict THEN 'strict_audit_failed' END, CASE WHEN fake THEN 'fake_run_detected' END, CASE WHEN NOT outs THEN 'required_output_missing' END, CASE WHEN n <> e THEN 'row_count_mismatch' END, CASE WHEN dup THEN 'duplicate_question_ids' END], lambda s: s IS NOT NULL) AS a, valid, rate FROM r)
SELECT k AS run, CASE WHEN NOT valid THEN 'excluded_run_invalid' WHEN rate > 0.05 THEN 'excluded_failure_rate' WHEN len(a) > 0 THEN 'excluded_strict_audit' ELSE 'valid' END AS status,
    array_to_string(list_concat(a, CASE WHEN NOT valid THEN ['run_invalid'] WHEN rate > 0.05 THEN ['failure_rate_exceeded'] ELSE [] END), ',') AS reasons FROM x""")
def va10_eligibility(spark, sf_dir):
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(
        k.alias("run"), F.lit(96).alias("expected_questions"), F.when(k % 13 == 0, 95).otherwise(96).alias("n_questions"), F.lit(96).alias("evaluated_rows"), F.lit(96).alias("source_rows"),
        (k % 9 != 0).alias("manifest_present"), F.when(k % 8 == 0, "invalid").otherwise("valid").alias("final_verdict"), (k % 7 != 0).alias("strict_audit_pass"), (k % 29 == 0).alias("fake_run_suspicious"),
        (k % 31 != 0).alias("outputs_present"), F.when(k % 37 == 0, 1).otherwise(0).alias("duplicate_questions"), F.lit(0).alias("distinct_questions"), (k % 5 != 0).alias("run_valid"), (k % 10 / 100.0).alias("failure_rate"),
    )
    return L.retrieval_eligibility(runs, 0.05).select("run", "status", F.array_join("reasons", ",").alias("reasons"))


@query("""
SELECT c_nationkey, c_mktsegment, array_to_string(list_sort(list(c_custkey)), ',') AS members, count(*) AS n, bool_and(c_acctbal > -900) AS complete, CASE WHEN count(*) < 2 THEN 'single_member' END AS incomparable FROM customer GROUP BY c_nationkey, c_mktsegment""")
def va12_comparison_groups(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "experiment_id")
    made = L.comparison_groups(runs, ["c_nationkey", "c_mktsegment"], F.col("c_acctbal") > -900)
    return made.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


# ---------------------------------------------------------------- summaries, reports, audits

@query("SELECT source, count(*) AS n, round(avg(a), 6) AS mean_hit_at_1, round(avg(b), 6) AS mean_recall_at_5 FROM (SELECT source, (doc_id % 2)::DOUBLE AS a, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 7) / 6e0 END AS b FROM documents) GROUP BY source")
def ag01_experiment_summary(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("source", (i % 2).cast("double").alias("hit_at_1"), F.when(i % 3 > 0, i % 7 / 6.0).alias("recall_at_5"))
    names = E.metric_columns(rows)
    return E.summarize(rows, "source", names).select("source", "n", *[six(f"mean_{m}").alias(f"mean_{m}") for m in names])


@query("""
WITH c AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang), g AS (SELECT lang, count(*) AS n, sum(n_chars) AS s FROM documents GROUP BY lang)
SELECT 'all' AS category, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS mean_n_chars FROM g UNION ALL SELECT coalesce(c.lang, g.lang), coalesce(n, 0), round(s / n, 6) FROM c FULL JOIN g ON c.lang = g.lang""")
def ag02_category_summary(spark, sf_dir):
    known = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "lang string")
    return E.summarize_with_all(table(spark, sf_dir, "documents"), "lang", known, ["n_chars"]).select("category", "n", six("mean_n_chars").alias("mean_n_chars"))


_ROUTED = "SELECT lang AS gold, source, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'en' ELSE upper(lang) END AS predicted, doc_id % 5 <> 0 AS validated, doc_id % 6 = 0 AS fallback, doc_id % 4 <> 0 AS index_used FROM documents"


def _routed(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("gold"), "source", F.when(i % 10 == 0, None).when(i % 7 == 0, "en").otherwise(F.upper("lang")).alias("predicted"), (i % 5 != 0).alias("validated"), (i % 6 == 0).alias("fallback"), (i % 4 != 0).alias("index_used"))


@query(f"""
SELECT source, count(*) AS n, round(avg((predicted IS NOT NULL)::INT), 6) AS coverage, round(avg(validated::INT), 6) AS validated_coverage, round(avg((lower(predicted) = gold)::INT), 6) AS accuracy,
    round(avg(coalesce(lower(predicted) = gold, FALSE)::INT * validated::INT), 6) AS effective_accuracy, round(avg(fallback::INT), 6) AS fallback_rate, round(avg((predicted IS NULL)::INT), 6) AS unknown_rate, round(avg(index_used::INT), 6) AS index_rate FROM ({_ROUTED}) GROUP BY source""")
def ag03_routing_report(spark, sf_dir):
    return E.routing_report(_routed(spark, sf_dir), ["source"])


@query(f"SELECT gold, coalesce(lower(predicted), 'unknown') AS predicted, count(*) AS n FROM ({_ROUTED}) GROUP BY ALL")
def ag04_confusion(spark, sf_dir):
    return E.confusion(_routed(spark, sf_dir).withColumn("predicted", F.lower("predicted")), "gold", "predicted")


@query(f"""
WITH x AS (SELECT gold, coalesce(lower(predicted), 'unknown') AS p FROM ({_ROUTED})), c AS (SELECT gold AS class FROM x UNION SELECT p FROM x)
SELECT class, count(*) FILTER (gold = class AND p = class) AS tp, count(*) FILTER (gold <> class AND p = class) AS fp, count(*) FILTER (gold = class AND p <> class) AS fn,
    coalesce(round(count(*) FILTER (gold = class AND p = class) / nullif(count(*) FILTER (p = class), 0), 6), 0) AS precision, coalesce(round(count(*) FILTER (gold = class AND p = class) / nullif(count(*) FILTER (gold = class), 0), 6), 0) AS recall FROM c, x GROUP BY class""")
def ag05_class_scores(spark, sf_dir):
    return E.class_scores(E.confusion(_routed(spark, sf_dir).withColumn("predicted", F.lower("predicted")), "gold", "predicted"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value < 20) AS failures, round(count(*) FILTER (value < 20) / count(*), 6) AS failure_rate, count(*) FILTER (value < 20) / count(*) <= 0.25 AS run_valid FROM events GROUP BY user_id")
def ag07_run_validity(spark, sf_dir):
    return E.run_validity(table(spark, sf_dir, "events"), "user_id", F.col("value") < 20, 0.25).withColumn("failure_rate", six("failure_rate"))


@query("SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean_score, count(v) AS valid_score, count(*) FILTER (event_id % 9 = 0) AS nan_score, round(count(v) / count(*), 6) AS coverage_score FROM (SELECT *, CASE WHEN event_id % 9 = 0 OR event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY event_type")
def ag09_semantic_summary(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.when(i % 9 == 0, F.lit(float("nan"))).when(i % 5 == 0, None).otherwise(F.col("value")).alias("score"))
    made = E.semantic_summary(rows, "event_type", ["score"])
    return made.withColumns({"mean_score": six("mean_score"), "coverage_score": six("coverage_score")})


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def ag14_duplicates(spark, sf_dir):
    return E.duplicates(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT sha256(text) AS key, count(*) AS n_values, array_to_string(list_sort(list(doc_id)), ',') AS values FROM documents GROUP BY text HAVING count(*) > 1")
def ag15_collisions(spark, sf_dir):
    made = E.collisions(table(spark, sf_dir, "documents"), F.sha2("text", 256), F.col("doc_id"))
    return made.withColumn("values", F.array_join(F.transform("values", lambda v: v.cast("string")), ","))


@query("""
WITH c AS (SELECT text AS value, count(*) AS n FROM documents GROUP BY text)
SELECT value, n, (SELECT sum(n) FROM c)::BIGINT AS total, round(n / (SELECT sum(n) FROM c), 6) AS share, n / (SELECT sum(n) FROM c) >= 0.8 AS suspicious FROM c ORDER BY n DESC, value LIMIT 1""")
def ag17_top_answer(spark, sf_dir):
    return E.most_frequent(table(spark, sf_dir, "documents"), F.col("text"))


@query(f"WITH {_POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM terms CROSS JOIN totals")
def ag19_term_statistics(spark, sf_dir):
    index = R.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.terms.crossJoin(F.broadcast(index.totals)).select("term", "df", six(F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))  # totals: one row


@query("SELECT coalesce(d.doc_id, l.doc_id, i.item_id) AS id, d.doc_id IS NOT NULL AS documents, l.doc_id IS NOT NULL AS labels, i.item_id IS NOT NULL AS benchmark FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id FULL JOIN benchmark i ON i.item_id = coalesce(d.doc_id, l.doc_id)")
def jn08_alignment(spark, sf_dir):
    return E.alignment(("documents", table(spark, sf_dir, "documents").select("doc_id")), ("labels", table(spark, sf_dir, "labels").select("doc_id")), ("benchmark", table(spark, sf_dir, "benchmark").select("item_id")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn10_pending(spark, sf_dir):
    return E.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT doc_id, 'quality' AS metric, quality::DOUBLE AS reported, (CASE WHEN doc_id % 17 = 0 THEN NULL ELSE quality END)::DOUBLE AS computed FROM labels WHERE doc_id % 17 = 0
UNION ALL SELECT doc_id, 'toxic', toxic, toxic + 0.001 * (doc_id % 2) FROM labels WHERE doc_id % 2 = 1""")
def jn06_reported_differences(spark, sf_dir):
    reported = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    computed = reported.select("doc_id", F.when(i % 17 != 0, F.col("quality")).alias("quality"), (F.col("toxic") + 0.001 * (i % 2)).alias("toxic"))
    return E.reported_differences(reported, computed, ["doc_id"], ["quality", "toxic"])


@query("SELECT doc_id, 'both' AS part FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'documents only' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def st02_set_operations(spark, sf_dir):
    d, x = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(x).withColumn("part", F.lit("both")).unionByName(d.subtract(x).withColumn("part", F.lit("documents only")))


@query(f"SELECT doc_id AS path, t.term FROM documents, (SELECT unnest([{', '.join(repr(t) for t in (*E.LEAK_TERMS, 'licensed under'))}]) AS term) t WHERE contains(lower(text), lower(t.term))")
def va04_leakage(spark, sf_dir):
    """The forbidden terms, and one that the documents do have."""
    return E.leakage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), [*E.LEAK_TERMS, "licensed under"])


@query("""
SELECT 'rows_present' AS "check", count(*) > 0 AS passed FROM documents UNION ALL SELECT 'ids_unique', count(*) = count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'no_blank_text', count(*) FILTER (trim(text) = '') = 0 FROM documents UNION ALL SELECT 'several_sources', count(DISTINCT source) > 1 FROM documents""")
def va05_run_checks(spark, sf_dir):
    one = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.trim("text") == "").alias("blank"), F.count_distinct("source").alias("sources"))
    return E.check_rows(one, {"rows_present": F.col("n") > 0, "ids_unique": F.col("n") == F.col("ids"), "no_blank_text": F.col("blank") == 0, "several_sources": F.col("sources") > 1})


@query("SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_docs, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS avg_chars, count(doc_id) - count(DISTINCT doc_id) AS duplicate_ids FROM documents")
def sc20_input_diagnostics(spark, sf_dir):
    from lodestone.sources.readers import input_diagnostics

    return input_diagnostics(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def sm03_event_windows(spark, sf_dir):
    from lodestone.streaming.events import hourly_counts

    return hourly_counts(spark, sf_dir)
