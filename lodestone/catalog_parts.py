"""Registered queries of saved indexes, range and pattern joins, files and tables, and of single expressions; each with the SQL that states the same, where one does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import _CHUNKS, _DENSE, _POSTINGS, LONG, _bm25_sql, _char_chunks, _index, _named, _questions, _vectors, query, six, table
from lodestone.config import RetrievalSettings
from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import evaluation as E
from lodestone.operators import intervals as I
from lodestone.operators import prompts as P
from lodestone.operators import retrieval as R
from lodestone.operators import vector_index as V
from lodestone.operators.block_index import BlockIndex
from lodestone.operators.nested import nested_differences
from lodestone.plans.pipelines import retrieve
from lodestone.session import scratch_dir
from lodestone.sources import readers, sinks
from lodestone.sources.reports import file_hashes, semantic_inputs


def _folder(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _ranked(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", "item_id", six("score").alias("score"), F.col("rank").cast(LONG).alias("rank"), *more)


# ---------------------------------------------------------------- saved indexes


@query(f"{_DENSE} SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def rt02_inverted_file(spark, sf_dir):
    """Saved, loaded, and searched in all of its lists."""
    q, v = _vectors(spark, sf_dir)
    made = V.InvertedFile.build(v, _folder(spark, "lists"))
    return _ranked(V.InvertedFile.load(spark, made.path).search(q.drop("predicted"), 5, nprobe=len(made.centres)))


@query(f"{_DENSE} SELECT query_id, item_id, round(score, 6) AS score, crank AS rank FROM c WHERE crank <= 5")
def rt02_inverted_file_category(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    made = V.InvertedFile.build(v, _folder(spark, "lists"))
    return _ranked(made.search(q.withColumnRenamed("predicted", "category"), 5, nprobe=len(made.centres), within="category"))


@query()
def rt02_default_lists(spark, sf_dir):
    """What the lists that the index probes by default find, each hit with the share of the ten best that its query found."""
    q, v = _vectors(spark, sf_dir)
    found = V.InvertedFile.build(v, _folder(spark, "lists")).search(q.drop("predicted"), 10)
    return _ranked(found.join(V.recall_at(found, R.dense_top_k(q, v, 10), 10), "query_id"), "recall")


@query()
def rt03_graph_walk(spark, sf_dir):
    """What a walk of the neighbour graph finds, with the share of the ten best."""
    q, v = _vectors(spark, sf_dir)
    found = V.NeighbourGraph.build(v, _folder(spark, "graph")).search(q.drop("predicted"), 10)
    return _ranked(found.join(V.recall_at(found, R.dense_top_k(q, v, 10), 10), "query_id"), "recall")


@query(f"{_DENSE}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS frank FROM s WHERE item_id % 100 = 3) SELECT query_id, item_id, round(score, 6) AS score, frank AS rank FROM f WHERE frank <= 50")
def rt03_rare_filter(spark, sf_dir):
    """A filter that leaves fewer than are asked for: all that pass are found."""
    q, v = _vectors(spark, sf_dir)
    graph = V.NeighbourGraph.build(v, _folder(spark, "graph"))
    return _ranked(graph.search(q.drop("predicted"), 50, candidates=50, where=F.col("item_id") % 100 == 3))


_BLOCKS = f"""
WITH {_POSTINGS}, {_bm25_sql('s', 1.5, 0.75)},
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s{{more}} WHERE score > 0{{condition}})
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"""


@query(_BLOCKS.replace("{more}", "").replace("{condition}", ""))
def rt06_block_max(spark, sf_dir):
    """The hits of ``rt06_bm25_topk``, without scoring the blocks that can't hold one."""
    return _named(BlockIndex.build(_index(spark, sf_dir)).search(_questions(spark, sf_dir), 10)[0])


@query(_BLOCKS.replace("{more}", " JOIN base USING (doc_id)").replace("{condition}", " AND source = 'src' || (item_id % 20)"))
def rt08_block_max_category(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    wanted = _questions(spark, sf_dir).select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("source")).join(docs, "source").select("query_id", "item_id")
    return _named(BlockIndex.build(_index(spark, sf_dir)).search(_questions(spark, sf_dir), 10, among=wanted)[0])


# ---------------------------------------------------------------- retrievers over vectors of letters

_LETTERS = "aeinrst"
_LETTERS_SQL = "[" + ", ".join(f"(length({{c}}) - length(replace({{c}}, '{x}', '')))::DOUBLE" for x in _LETTERS) + "]"
_TEXT_VECTORS = f"""
WITH v AS (SELECT doc_id AS item_id, source AS category, {_LETTERS_SQL.format(c='text')} AS e FROM documents),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS category, {_LETTERS_SQL.format(c='text')} AS e FROM benchmark),
s AS (SELECT query_id, item_id, v.category AS category, q.category AS wanted, CASE WHEN list_dot_product(q.e, q.e) > 0 AND list_dot_product(v.e, v.e) > 0 THEN list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) ELSE 0 END AS score FROM q CROSS JOIN v)"""


def _letters(c) -> F.Column:
    """How often each of some letters stands in a text: an embedding that SQL can state."""
    return F.array(*[(F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))).cast("double") for x in _LETTERS])


def _corpus(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("category"))
    return questions, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("source").alias("category"))


@query(f"""{_TEXT_VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s),
b AS (SELECT query_id, item_id, score + CASE WHEN category = wanted THEN 0.01e0 ELSE 0 END AS score, item_id % 3 <> 0 AS ok, rank FROM r WHERE rank <= 20),
f AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM b),
k AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS rank FROM f WHERE ok OR NOT any_ok)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM k WHERE rank <= 5""")
def rt04_dense_retriever(spark, sf_dir):
    """Twenty hits, a boost for those of the question's category, a filter, and the five best of what is left."""
    q, c = _corpus(spark, sf_dir)
    boost = lambda rows: F.when(F.col("category") == F.concat(F.lit("src"), F.col("query_id") % 20), 0.01).otherwise(0.0)
    return _ranked(retrieve(q.drop("category"), c, RetrievalSettings(retriever="dense", top_k=5, fetch_k=20), _letters, boost=boost, keep=lambda rows: F.col("item_id") % 3 != 0))


@query(f"""{_TEXT_VECTORS},
own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s WHERE category = wanted),
every AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s),
n AS (SELECT query_id, bool_or(category = wanted) AS found FROM s GROUP BY query_id)
SELECT query_id, item_id, round(score, 6) AS score, rank, 'category' AS retrieval_mode, NULL::VARCHAR AS fallback_reason FROM own JOIN n USING (query_id) WHERE found AND rank <= 5
UNION ALL SELECT query_id, item_id, round(score, 6), rank, 'global', 'category_retrieval_empty' FROM every JOIN n USING (query_id) WHERE NOT found AND rank <= 5""")
def rt13_category_retriever(spark, sf_dir):
    q, c = _corpus(spark, sf_dir)
    return _ranked(retrieve(q, c, RetrievalSettings(retriever="category", top_k=5), _letters), "retrieval_mode", "fallback_reason")


@query(f"""{_TEXT_VECTORS}, {_POSTINGS}, {_bm25_sql('t', 1.5, 0.75)},
l1 AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 20),
l2 AS (SELECT * FROM (SELECT item_id AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM t WHERE score > 0) WHERE rank <= 20),
fused AS (SELECT query_id, item_id, coalesce(2e0 / (60 + l1.rank), 0) + coalesce(1e0 / (60 + l2.rank), 0) AS score, l1.rank AS r1, l2.rank AS r2 FROM l1 FULL JOIN l2 USING (query_id, item_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r1 IS NULL, coalesce(r1, r2), item_id) AS rank FROM fused)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
def rt10_weighted_hybrid(spark, sf_dir):
    """Both legs with their own fetch counts and weights."""
    q, c = _corpus(spark, sf_dir)
    settings = RetrievalSettings(retriever="hybrid", top_k=10, dense_fetch_k=20, bm25_fetch_k=20, dense_weight=2.0)
    return _ranked(retrieve(q.drop("category"), c, settings, _letters))


# ---------------------------------------------------------------- ranges


@query(f"""
WITH {_CHUNKS} p AS (SELECT doc_id, item_id, CASE WHEN (doc_id + item_id) % 11 > 0 THEN start END AS start, CASE WHEN (doc_id + item_id) % 11 > 0 THEN "end" END AS "end" FROM c),
s AS (SELECT doc_id, 'only' AS parent_id, 0 AS s_start, n_chars::BIGINT AS s_end, 0 AS level, 0 AS ordinal FROM documents WHERE doc_id % 5 = 1
    UNION ALL SELECT doc_id, 'only', 0, 10, 2, 0 FROM documents WHERE doc_id % 5 = 2
    UNION ALL SELECT doc_id, 'part' || i, i * (n_chars // 4), (i + 1) * (n_chars // 4) + 100 * (i % 2), 1 + i % 2, i FROM documents, range(4) AS r(i) WHERE doc_id % 5 = 4 OR (doc_id % 5 = 3 AND i < 2)),
n AS (SELECT doc_id, count(*) AS n, any_value(level) AS level FROM s GROUP BY doc_id),
m AS (SELECT p.doc_id, item_id, parent_id, level, ordinal, s_end - s_start AS span, least("end", s_end) - greatest(start, s_start) AS overlap, s_start <= start AND s_end >= "end" AS inside FROM p JOIN s ON p.doc_id = s.doc_id AND start < s_end AND s_start < "end" AND s_start < s_end),
b AS (SELECT doc_id, item_id, count(*) FILTER (inside) AS held, count(*) FILTER (NOT inside) AS touched, arg_min(parent_id, (-level, span, ordinal)) FILTER (inside) AS deep, arg_min(level, (-level, span, ordinal)) FILTER (inside) AS deep_level, arg_min(parent_id, (-overlap, -level, ordinal)) FILTER (NOT inside) AS large FROM m GROUP BY doc_id, item_id),
k AS (SELECT p.doc_id, p.item_id, start, n, n.level, held, touched, deep, deep_level, large,
    CASE WHEN n IS NULL THEN 'no_sections' WHEN n = 1 AND n.level = 0 THEN 'document_level_fallback' WHEN n = 1 THEN 'sole_section' WHEN start IS NULL THEN 'text_not_found'
        WHEN held > 0 THEN 'fully_contained' WHEN touched > 1 THEN 'boundary_spanning' WHEN touched = 1 THEN 'overlap_based' ELSE 'no_overlap_fallback' END AS mapping
    FROM p LEFT JOIN n ON n.doc_id = p.doc_id LEFT JOIN b ON b.doc_id = p.doc_id AND b.item_id = p.item_id)
SELECT doc_id, item_id, CASE WHEN n = 1 THEN 'only' WHEN mapping IN ('no_sections', 'text_not_found') THEN NULL WHEN mapping = 'no_overlap_fallback' THEN 'part0' ELSE coalesce(deep, large) END AS parent_id, mapping, mapping = 'boundary_spanning' AS boundary_spanning FROM k""")
def rt24_section_mapping(spark, sf_dir):
    """Documents without sections, with one, with few and with overlapping ones; some chunks weren't found."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    quarter, n, k = F.floor(F.col("n_chars") / 4), F.col("n_chars").cast(LONG), F.col("i")
    one = lambda rest, end, level: docs.where(i % 5 == rest).select("doc_id", F.lit("only").alias("parent_id"), F.lit(0).cast(LONG).alias("s_start"), end.cast(LONG).alias("s_end"), F.lit(level).alias("level"), F.lit(0).alias("ordinal"))
    parts = docs.where(i % 5 > 2).select("doc_id", quarter.alias("q"), F.explode(F.when(i % 5 == 4, F.sequence(F.lit(0), F.lit(3))).otherwise(F.sequence(F.lit(0), F.lit(1)))).alias("i"))
    parts = parts.select("doc_id", F.concat(F.lit("part"), k).alias("parent_id"), (k * F.col("q")).alias("s_start"), ((k + 1) * F.col("q") + 100 * (k % 2)).alias("s_end"), (1 + k % 2).alias("level"), k.alias("ordinal"))
    found = (i + F.col("item_id")) % 11 > 0
    chunks = _char_chunks(docs).withColumns({"start": F.when(found, F.col("start")), "end": F.when(found, F.col("end"))})
    return I.map_to_sections(chunks, one(1, n, 0).unionByName(one(2, F.lit(10), 2)).unionByName(parts))


@query("""
WITH t AS (SELECT doc_id, lower(text) AS text FROM documents), p AS (SELECT n_nationkey AS pattern_id, lower(n_name) AS pattern FROM nation UNION ALL SELECT 100 + r_regionkey, lower(substr(r_name, 1, 2)) FROM region)
SELECT doc_id AS text_id, pattern_id, instr(text, pattern) - 1 AS first FROM t JOIN p ON contains(text, pattern)""")
def jn12_many_patterns(spark, sf_dir):
    """Names of nations and beginnings of names of regions in whole texts; each text is gone over once."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast(LONG).alias("pattern_id"), F.lower("n_name").alias("pattern"))
    names = names.unionByName(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast(LONG).alias("pattern_id"), F.lower(F.substring("r_name", 1, 2)).alias("pattern")))
    from lodestone.operators.patterns import find_patterns

    return find_patterns(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")), names).select("text_id", "pattern_id", "first")


# ---------------------------------------------------------------- chunkers in SQL

_WINDOWS = r"""
WITH w AS (SELECT doc_id, text, n, s, least(s + 50, n) AS e FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 50 THEN least(length(text), 1) ELSE 40 * ceil((length(text) - 50) / 40e0)::BIGINT + 1 END, 40)) AS s FROM documents)),
b AS (SELECT doc_id, s, e, text[s + 1:e] AS body FROM w),
k AS (SELECT doc_id, s, e, regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '') AS text FROM b WHERE regexp_matches(body, '\S'))
"""


def _by_characters(t):
    return C.token_windows(t, 50, 10, list, "".join)


@query(f'{_WINDOWS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ordinal, s AS start, e AS "end", sha256(text) AS digest FROM k')
def ch02_token_windows(spark, sf_dir):
    """Characters as tokens; blank windows take no number."""
    rows = C.chunk_documents(table(spark, sf_dir, "documents"), _by_characters)
    return rows.select("doc_id", F.col("ordinal").cast(LONG).alias("ordinal"), "start", "end", F.sha2("text", 256).alias("digest"))


@query(f'{_WINDOWS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ordinal, s AS start, e AS "end", sha256(text) AS digest FROM k')
def ux01_chunks_in_sql(spark, sf_dir):
    """The same chunker as a table function, joined laterally."""
    C.register_chunker(spark, "chunk_by_characters", _by_characters)
    table(spark, sf_dir, "documents").createOrReplaceTempView("ux01_documents")
    return spark.sql('SELECT d.doc_id, CAST(c.ordinal AS BIGINT) AS ordinal, c.start, c.end, sha2(c.text, 256) AS digest FROM ux01_documents d, LATERAL chunk_by_characters(d.text) c')


@query("SELECT doc_id, sha256(doc_id || ':' || 0 || ':' || length(text) || ':' || text) AS hashed, doc_id || ':chunk:' || lpad((doc_id % 50 + 1)::VARCHAR, 4, '0') AS keyed, doc_id || ':0-' || length(text) AS placed FROM documents")
def ch15_ids(spark, sf_dir):
    i, n = F.col("doc_id"), F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", C.hashed_chunk_id(i, F.lit(0), n, F.col("text")).alias("hashed"), C.keyed_chunk_id(i.cast("string"), i % 50).alias("keyed"), C.position_chunk_id(i, F.lit(0), n).alias("placed"))


@query("""
WITH w AS (SELECT doc_id, text, replace(text, chr(10), ' ') AS flat FROM documents),
c AS (SELECT doc_id, text, flat, array_to_string(string_split(flat, ' ')[1:3], ' ') AS one, array_to_string(string_split(flat, ' ')[5:9], ' ') AS two FROM w WHERE len(string_split(flat, ' ')) >= 9),
h AS (SELECT *, instr(flat, one) - 1 AS first, instr(flat[instr(flat, one) + 1:], two) AS after FROM c)
SELECT doc_id, first AS start, first + length(one) AS "end", sha256(text[first + 1:first + length(one)]) AS digest FROM h WHERE one <> ''
UNION ALL SELECT doc_id, first + after, first + after + length(two), sha256(text[first + after + 1:first + after + length(two)]) FROM h WHERE after > 0""")
def ch17_located_chunks(spark, sf_dir):
    """Words of a text, one space between them, found again in it: from the last find on, and not at all if they aren't there."""

    def located(t):
        words = (t or "").split()
        if len(words) >= 9:
            for at in C.locate_chunks(t, [" ".join(words[:3]), " ".join(words[4:9]), "\x01 nowhere"]):
                if at is not None:
                    yield *at, t[at[0] : at[1]], "located", False

    return C.chunk_documents(table(spark, sf_dir, "documents"), located).select("doc_id", "start", "end", F.sha2("text", 256).alias("digest"))


@query("""
WITH h AS (SELECT user_id AS query_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) AS rank FROM events),
k AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'child' WHEN length(event_type) % 2 = 1 THEN 'smaller_parent' ELSE 'parent' END AS kind FROM h WHERE rank <= 8),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN kind = 'parent' THEN event_type ELSE event_id::VARCHAR END ORDER BY rank) AS n FROM k)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, event_id::VARCHAR AS item_id, CASE kind WHEN 'parent' THEN event_type WHEN 'smaller_parent' THEN 'part of ' || event_type END AS parent_id,
    CASE kind WHEN 'parent' THEN 'all of ' || event_type WHEN 'smaller_parent' THEN 'some of ' || event_type ELSE 'event ' || event_id END AS text, kind FROM f WHERE n = 1) WHERE rank <= 3""")
def rt23_parent_expansion(spark, sf_dir):
    """Events in the place of chunks, their kinds in that of sections: some sections are too long, some events have none."""
    kind = F.col("event_type")
    hits = R.top_k(table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.col("value").alias("score"), "event_type"), 8)
    part = lambda i, t, w: F.struct(i.alias("parent_id"), t.alias("text"), F.lit(w).alias("words"))
    long = F.array(part(kind, F.concat(F.lit("all of "), kind), 900), part(F.concat(F.lit("part of "), kind), F.concat(F.lit("some of "), kind), 5))
    short = F.array(part(kind, F.concat(F.lit("all of "), kind), 5))
    parents = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<struct<parent_id:string,text:string,words:int>>")).when(F.length(kind) % 2 == 1, long).otherwise(short)
    made = R.expand_parents(hits.select("query_id", "rank", "item_id", F.concat(F.lit("event "), "item_id").alias("text"), parents.alias("parents")), 100, 3)
    return made.withColumn("rank", F.col("rank").cast(LONG))


# ---------------------------------------------------------------- files and tables


def _json_lines(spark, rows: DataFrame, name: str) -> str:
    at = _folder(spark, name)
    rows.write.json(at)
    return at


@query("SELECT doc_id::VARCHAR AS document_id, sha256(text) AS digest, doc_id::VARCHAR AS original_context_id, source AS doc_name, lang AS sprache, source AS source_file FROM documents WHERE trim(text) <> ''")
def sc02_read_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''")
    at = _json_lines(spark, docs.select(F.col("doc_id").cast("string").alias("doc_key"), "text", F.col("source").alias("doc_name"), F.col("lang").alias("sprache")), "documents")
    return readers.read_documents(spark, at).select("document_id", F.sha2("text", 256).alias("digest"), "original_context_id", "metadata.doc_name", "metadata.sprache", "metadata.source_file")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE 'c' || doc_id END AS document_id, sha256(CASE WHEN doc_id % 3 = 0 THEN source ELSE text END) AS digest FROM documents WHERE trim(text) <> ''")
def sc03_generic_documents(spark, sf_dir):
    i, text = F.col("doc_id"), lambda c, p: F.concat(F.lit(p), c)
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''").select(F.when(i % 2 == 0, text(i, "d")).alias("document_id"), text(i, "c").alias("context_id"), "text", F.when(i % 3 == 0, F.col("source")).alias("context"))
    return readers.read_documents(spark, _json_lines(spark, docs, "generic"), generic=True).select("document_id", F.sha2("text", 256).alias("digest"))


@query("SELECT count(*) AS lines, count(*) AS numbers, 0::BIGINT AS gaps FROM documents")
def sc01_numbered_lines(spark, sf_dir):
    """Every line has a number of its own in its file, and the numbers go from 1 to the file's count."""
    lines = readers.numbered_lines(spark, _json_lines(spark, table(spark, sf_dir, "documents"), "lines"))
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("line").alias("d"), F.min("line").alias("low"), F.max("line").alias("high"))
    return files.agg(F.sum("n").alias("lines"), F.sum("d").alias("numbers"), F.sum(F.col("low") - 1 + F.col("high") - F.col("n")).alias("gaps"))


@query("SELECT 'Q' || item_id AS question_id, regexp_replace(regexp_replace(text, '^ +', ''), ' +$', '') AS question FROM benchmark")
def sc05_read_questions(spark, sf_dir):
    return readers.read_questions(spark, _json_lines(spark, table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Q"), "item_id").alias("question_id"), F.col("text").alias("frage")), "questions"))


@query("SELECT doc_id, source, NULL::BIGINT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def sc07_results_of_runs(spark, sf_dir):
    runs = [_json_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "source"), "run1"), _json_lines(spark, table(spark, sf_dir, "labels").select("doc_id", "quality"), "run2")]
    return readers.read_results(spark, runs).select("doc_id", "source", "quality")


@query("SELECT DISTINCT 'Q' || (doc_id % 40) AS question_id, 'c' || (doc_id % 90) AS chunk_id FROM documents")
def sc09_gold_chunks(spark, sf_dir):
    """Questions come several times, with blanks around their chunks."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit(" Q"), i % 40).alias("question_id"), F.lit("c").alias("chunk_config_id"), F.array(F.concat(F.lit("c"), i % 90, F.lit(" ")), F.lit(" ")).alias("gold_relevant_chunk_ids"))
    return readers.read_gold_chunks(spark, _json_lines(spark, rows, "gold"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'q' || doc_id WHEN doc_id % 3 = 1 THEN 'u' || doc_id WHEN doc_id % 7 > 0 THEN 'i' || doc_id END AS question_id FROM documents")
def sc14_question_ids(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(i % 3 == 0, F.concat(F.lit("q"), i)).alias("question_id"), F.when(i % 3 == 1, F.concat(F.lit(" u"), i)).otherwise(" ").alias("uid"), F.when(i % 7 > 0, F.concat(F.lit("i"), i)).otherwise("").alias("id"))
    return readers.question_ids(rows)


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0")
def sk04_pending(spark, sf_dir):
    """Answers are appended twice; some fail, and stay open."""
    docs, i, at = table(spark, sf_dir, "documents"), F.col("doc_id"), _folder(spark, "results")
    rows = docs.select("doc_id", F.concat(F.lit("Q"), i).alias("question_id"), F.when(i % 4 == 0, "down").alias("error"), F.lit("text").alias("generated_answer"), (i % 3).alias("part"))
    sinks.append_results(rows.where("part = 0 and doc_id % 2 = 0"), at)
    sinks.append_results(rows.where("part = 0 and doc_id % 2 = 1"), at)
    done = spark.read.schema(rows.schema).json(at).where(sinks.valid_result(F.col("error"), F.col("question_id"), F.col("generated_answer")))
    return E.pending(docs.select("doc_id", "source"), done, "doc_id")


@query("SELECT event_type AS event, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def sk05_event_log(spark, sf_dir):
    events, at = table(spark, sf_dir, "events"), _folder(spark, "log")
    sinks.append_events(events.select(F.col("event_type").alias("event"), "user_id", "value"), at, "run")
    log = spark.read.schema("run_id string, at string, event string, payload string").json(at)
    return log.groupBy("event").agg(F.count("*").alias("n"), F.sum(F.get_json_object("payload", "$.user_id").cast(LONG)).alias("users"))


@query("SELECT s_name AS name, s_suppkey::VARCHAR AS key, NULL::VARCHAR AS missing FROM supplier")
def sk07_csv(spark, sf_dir):
    at = _folder(spark, "suppliers") + ".csv"
    sinks.write_csv(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal"), at, ["name", "key", "missing"])
    return spark.read.schema("name string, key string, missing string").option("header", True).csv(at)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN -2 ELSE n_chars END::BIGINT AS n_chars FROM documents UNION ALL SELECT doc_id + 10000000, -1 FROM documents WHERE doc_id % 100 = 3")
def sk11_upsert(spark, sf_dir):
    """Rows are replaced, added, and repeated within the batch: the last of each key stays."""
    docs, at, i = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast(LONG).alias("n_chars")), _folder(spark, "table"), F.col("doc_id")
    sinks.write_buckets(docs.withColumn("seq", F.lit(0)), at, "doc_id", 16)
    old = docs.where(i % 10 == 3)
    batch = old.select("doc_id", F.lit(-1).cast(LONG).alias("n_chars"), F.lit(1).alias("seq")).unionByName(old.select("doc_id", F.lit(-2).cast(LONG).alias("n_chars"), F.lit(2).alias("seq")))
    batch = batch.unionByName(docs.where(i % 100 == 3).select((i + 10_000_000).alias("doc_id"), F.lit(-1).cast(LONG).alias("n_chars"), F.lit(1).alias("seq")))
    return sinks.upsert(at, batch, "doc_id", "seq").select("doc_id", "n_chars")


@query("SELECT doc_id, quality::BIGINT AS quality FROM labels")
def sk12_published(spark, sf_dir):
    """An alias is pointed at one table, then at another."""
    at = _folder(spark, "alias")
    for name, rows in (("one", table(spark, sf_dir, "documents").select("doc_id")), ("two", table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast(LONG).alias("quality")))):
        rows.write.parquet(f"{at}-{name}")
        sinks.publish(spark, at, f"{at}-{name}")
    return sinks.published(spark, at)


@query("SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'changed' ELSE upper(source) END AS source, 1::BIGINT AS rebuilt FROM documents")
def sk13_refreshed_index(spark, sf_dir):
    """An index is built, and brought up to date after one document has changed: one bucket is built again."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "source"), _folder(spark, "index")
    build = lambda rows: rows.select("doc_id", F.when(F.col("source") == "changed", F.col("source")).otherwise(F.upper("source")).alias("source"))
    sinks.refresh(docs, at, "doc_id", ["doc_id", "source"], build, 32)
    first = docs.agg(F.min("doc_id").alias("first"))
    now = docs.crossJoin(F.broadcast(first)).select("doc_id", F.when(F.col("doc_id") == F.col("first"), "changed").otherwise(F.col("source")).alias("source"))  # one row
    changed = sinks.refresh(now, at, "doc_id", ["doc_id", "source"], build, 32)
    return sinks.read_buckets(spark, at).withColumn("rebuilt", F.lit(len(changed)).cast(LONG))


@query("""
WITH m AS (SELECT doc_id, json_object('run', json_object('lang', lang, 'n', n_chars, 'tags', [source, lang]), 'source', source, 'k', doc_id % 4) AS l,
    json_object('run', json_object('lang', CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END, 'n', CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END, 'tags', CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE [source, lang] END), 'source', source, 'k', 1, 'more', CASE WHEN doc_id % 7 = 0 THEN 5 END) AS r FROM documents)
SELECT doc_id, path, json_extract(l, '$.' || path)::VARCHAR AS "left", nullif(json_extract(r, '$.' || path)::VARCHAR, 'null') AS "right" FROM m, (SELECT unnest(['run.lang', 'run.n', 'run.tags', 'source', 'k', 'more']) AS path)
WHERE json_extract(l, '$.' || path)::VARCHAR IS DISTINCT FROM nullif(json_extract(r, '$.' || path)::VARCHAR, 'null')""")
def st05_nested_differences(spark, sf_dir):
    """Two tables of manifests, told apart field by field."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")

    def manifest(lang, n, tags, k, more):
        return docs.select("doc_id", F.to_json(F.struct(F.struct(lang.alias("lang"), n.alias("n"), tags.alias("tags")).alias("run"), "source", k.alias("k"), more.alias("more"))).alias("doc"))

    lang, n, tags = F.col("lang"), F.col("n_chars"), F.array("source", "lang")
    left = manifest(lang, n, tags, i % 4, F.lit(None).cast("int"))
    right = manifest(F.when(i % 3 == 0, "xx").otherwise(lang), F.when(i % 5 == 0, n + 1).otherwise(n), F.when(i % 2 == 0, F.array("lang")).otherwise(tags), F.lit(1), F.when(i % 7 == 0, 5))
    return nested_differences(left, right, "doc_id", "doc")


# ---------------------------------------------------------------- joins and sets of hits


@query("SELECT e.vec_id, d.source, l.quality FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id")
def jn04_judged_rows(spark, sf_dir):
    """Result rows with their questions, contexts and, where there is one, gold."""
    key = lambda n, c, *more: table(spark, sf_dir, n).select(F.col(c).alias("question_id"), *more)
    rows = key("embeddings", "vec_id").join(key("documents", "doc_id", F.col("doc_id").alias("known")), "question_id")
    made = semantic_inputs(rows, key("documents", "doc_id", "source"), key("embeddings", "vec_id", "label"), key("labels", "doc_id", "quality"))
    return made.select(F.col("question_id").alias("vec_id"), "source", "quality")


@query("SELECT DISTINCT trim(source) AS category FROM documents WHERE trim(source) <> ''")
def ag21_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.trim("source").alias("category")).where("category <> ''").distinct()


@query("""
WITH s AS (SELECT user_id AS query_id, event_id AS item_id, value AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def wn06_top_of_each(spark, sf_dir):
    return _ranked(R.top_k(table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.col("value").alias("score")), 3))


@query("""
WITH r AS (SELECT o_custkey AS question_id, o_orderkey AS write_seq, CASE WHEN o_orderkey % 3 = 0 THEN 'down' END AS error, o_orderpriority AS answer FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY write_seq DESC) AS n FROM r WHERE error IS NULL)
SELECT question_id, write_seq, answer FROM w WHERE n = 1""")
def wn08_last_writer(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("write_seq"), F.when(F.col("o_orderkey") % 3 == 0, "down").alias("error"), F.col("o_orderpriority").alias("answer"))
    return E.reconcile(rows, "question_id", "write_seq", sinks.valid_result(F.col("error"), F.col("question_id").cast("string"), F.col("answer"))).select("question_id", "write_seq", "answer")


@query("SELECT doc_id, len(list_intersect(list_distinct(w[1:20]), list_distinct(w[11:40]))) AS shared FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)")
def st03_shared_tokens(spark, sf_dir):
    w = T.search_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(F.array_distinct(F.slice(w, 1, 20)), F.array_distinct(F.slice(w, 11, 30)))).cast(LONG).alias("shared"))


@query("""
WITH x AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:30] AS w FROM documents), y AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM x), z AS (SELECT doc_id, t, min(i) AS i FROM y GROUP BY doc_id, t)
SELECT doc_id, coalesce(array_to_string(list(t ORDER BY i), ' '), '') AS words FROM x LEFT JOIN z USING (doc_id) GROUP BY doc_id""")
def st04_first_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.slice(T.search_tokens(F.col("text")), 1, 30)), " ").alias("words"))


# ---------------------------------------------------------------- metrics and texts


@query("""
WITH x AS (SELECT doc_id, list_transform(range(8), lambda i: ((doc_id * 7 + i * i) % 11)::VARCHAR) AS r, list_distinct(list_transform(range(doc_id % 6), lambda i: ((doc_id + 2 * i) % 11)::VARCHAR)) AS g FROM documents),
h AS (SELECT doc_id, g, list_filter([1, 2, 3, 4, 5], lambda i: list_contains(g, r[i]) AND list_position(r, r[i]) = i) AS hits FROM x)
SELECT doc_id, round(CASE WHEN len(g) > 0 THEN coalesce(list_sum(list_transform(hits, lambda i: 1 / log2(i + 1))), 0) / list_sum(list_transform(range(1, least(len(g), 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM h""")
def mx03_ndcg(spark, sf_dir):
    """Repeated items take their slots and gain nothing."""
    i, n = F.col("doc_id"), (F.col("doc_id") % 6).cast("int")
    retrieved = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((i * 7 + k * k) % 11).cast("string"))
    gold = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: ((i + 2 * k) % 11).cast("string"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", six(M.rank_metrics(retrieved, gold, 5)["ndcg"]).alias("ndcg"))


@query("SELECT doc_id, (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0) AS failed, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 0 ELSE n_chars END::DOUBLE AS quality FROM documents")
def mx12_failed_rows(spark, sf_dir):
    i = F.col("doc_id")
    failed = M.generation_failed(F.when(i % 5 == 0, "down").otherwise(" "), F.when(i % 7 == 0, F.lit(False)), F.when(i % 11 == 0, " ").otherwise("text"))
    return table(spark, sf_dir, "documents").select("doc_id", failed.alias("failed"), F.when(failed, 0.0).otherwise(F.col("n_chars").cast("double")).alias("quality"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR trim(lang) = '' OR lang IS NULL THEN NULL WHEN doc_id % 4 = 0 THEN (lower(lang) = 'en')::INT ELSE 1 END::DOUBLE AS accuracy FROM documents")
def mx14_category_accuracy(spark, sf_dir):
    i = F.col("doc_id")
    predicted = F.when(i % 6 == 0, " ").when(i % 4 == 0, " EN ").otherwise(F.upper("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", M.category_accuracy(predicted, F.col("lang")).alias("accuracy"))


@query(r"""
SELECT doc_id, nullif(replace(lower(trim(regexp_replace(left(text, 60), '\s+', ' ', 'g'))), 'ß', 'ss'), '') AS normalized, nullif(trim(regexp_replace(left(text, 40), '\s+', ' ', 'g')), '') AS optional,
    CASE WHEN doc_id % 3 = 0 THEN doc_id WHEN doc_id % 3 = 1 THEN -doc_id END AS number FROM documents""")
def mx21_normalizers(spark, sf_dir):
    i, part = F.col("doc_id"), lambda n: F.substring("text", 1, n)
    written = F.when(i % 3 == 0, F.concat(F.lit(" +"), i)).when(i % 3 == 1, F.concat(F.lit("-"), i, F.lit(" "))).otherwise(F.concat(i, F.lit(".5")))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(part(60)).alias("normalized"), T.optional_string(part(40)).alias("optional"), T.safe_int(written).alias("number"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS search, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-ZäöüßÄÖÜ0-9]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")))) AS content FROM documents")
def mx22_tokenizers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.search_tokens(F.col("text"))).cast(LONG).alias("search"), F.size(T.content_tokens(F.col("text"))).cast(LONG).alias("content"))


@query("""
WITH c AS (SELECT vec_id % 50 AS query_id, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS rank, 'context ' || vec_id AS text FROM embeddings),
l AS (SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS parts, count(*) AS n FROM c GROUP BY query_id),
w AS (SELECT item_id AS query_id, coalesce(n, 0) AS n, 'Context:' || chr(10) || coalesce(parts, '') || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS whole FROM benchmark LEFT JOIN l ON l.query_id = item_id)
SELECT query_id, sha256(left(whole, 120)) AS digest, n::BIGINT AS n_contexts, length(whole) > 120 AS truncated FROM w""")
def mx24_prompts(spark, sf_dir):
    contexts = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("query_id"), F.col("vec_id").alias("item_id"), (-F.col("vec_id")).cast("double").alias("score"), F.concat(F.lit("context "), "vec_id").alias("text"))
    ranked = R.top_k(contexts, 1 << 30).select("query_id", "rank", "text")
    made = P.build_prompts(_questions(spark, sf_dir), ranked, max_chars=120)
    return made.select("query_id", F.sha2("prompt", 256).alias("digest"), F.col("n_contexts").cast(LONG).alias("n_contexts"), "truncated")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'k' || doc_id WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 4 = 2 THEN lang ELSE 'd' || doc_id END AS id, coalesce(CASE WHEN doc_id % 5 = 0 THEN nullif(lang, '') END, CASE WHEN doc_id % 2 = 0 THEN source END, 'gold') AS answer FROM documents")
def pr18_first_of_several(spark, sf_dir):
    """The first field that holds something: stable identifiers, and answers under one of their names."""
    i, k = F.col("doc_id"), F.col("doc_id") % 4
    stable = T.first_truthy(F.when(k == 0, F.concat(F.lit("k"), i)).otherwise(""), F.when(k == 1, F.col("source")), F.when(k == 2, F.col("lang")).otherwise(""), F.concat(F.lit("d"), i))
    answer = T.first_truthy(F.when(i % 5 == 0, F.col("lang")), F.when(i % 2 == 0, F.col("source")).otherwise(""), F.lit("gold"))
    return table(spark, sf_dir, "documents").select("doc_id", stable.alias("id"), answer.alias("answer"))


@query("""
WITH h AS (SELECT user_id AS query_id, event_id AS item_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, event_id) AS rank FROM events)
SELECT c_custkey AS query_id, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 4), '') AS chunks, count(*) FILTER (rank <= 4) AS n FROM customer LEFT JOIN h ON query_id = c_custkey GROUP BY c_custkey""")
def pr16_exported_rows(spark, sf_dir):
    hits = R.top_k(table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.col("value").alias("score"), F.col("event_type").alias("text")), 4)
    made = P.export_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")), hits)
    return made.select("query_id", F.array_join("retrieved_chunk_ids", ",").alias("chunks"), F.col("n_retrieved").cast(LONG).alias("n"))


@query("SELECT count(*) AS files, count(DISTINCT ids) AS hashes FROM (SELECT source, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY source)")
def mx27_file_hashes(spark, sf_dir):
    """A file for each source, hashed where the tasks run."""
    at = _folder(spark, "hashes")
    table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("value")).repartition("source").write.partitionBy("source").text(at)
    found = file_hashes(spark, f"{at}/source=*/*.txt")
    return found.agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("hashes"))
