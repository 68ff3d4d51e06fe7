"""The registered queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def op1_pii_pseudonyms(spark, sf_dir):
    from .pii import pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents"), key="corpus-key-1")


def op2_embedding_dedup(spark, sf_dir):
    from .cover_tree import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"), least=0.93)


def op3_simhash_dedup(spark, sf_dir):
    from .simhash import simhash_dedup

    return simhash_dedup(table(spark, sf_dir, "documents"), shingle=4, budget=4)


def op5_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark, sf_dir):
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    from .mixing import label_quality, mix_sources

    quality = label_quality(table(spark, sf_dir, "labels"))
    return mix_sources(table(spark, sf_dir, "documents"), quality=quality).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op6_extendible_shards(spark, sf_dir):
    from .sharding import extendible_shards

    return extendible_shards(table(spark, sf_dir, "documents"), max_bytes=1 << 20)


def op9_license_scan(spark, sf_dir):
    from .licenses import document_paths, scan_licenses

    found = scan_licenses(document_paths(table(spark, sf_dir, "documents")))
    return found.withColumn("doc_id", F.substring_index("path", "/", -1).cast("long"))


def op11_line_quality(spark, sf_dir):
    from .line_quality import line_quality

    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark, sf_dir):
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"), least=3, top=200)


def op13_embedding_whitening(spark, sf_dir):
    from .whitening import embedding_whitening

    return embedding_whitening(table(spark, sf_dir, "embeddings"), k=4, scale=256)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms,
        op2_embedding_dedup,
        op3_simhash_dedup,
        op4_best_fit_packing,
        op5_exact_dedup,
        op6_extendible_shards,
        op7_toxicity,
        op8_language_id,
        op9_license_scan,
        op10_mix_sources,
        op11_line_quality,
        op12_source_divergence,
        op13_embedding_whitening,
    )
}

ORACLE_SQL = {
    "op6_extendible_shards": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, ('0x' || md5(coalesce(doc_id::VARCHAR, '|' || md5(coalesce(text, ''))))[1:15])::BIGINT AS bits FROM documents
        ), open AS (
            SELECT 0 AS depth, '' AS shard, sum(bytes)::BIGINT AS shard_bytes FROM docs
            UNION ALL
            SELECT o.depth + 1, lpad(bin(d.bits), 60, '0')[1:o.depth + 1], (sum(d.bytes) OVER (PARTITION BY lpad(bin(d.bits), 60, '0')[1:o.depth + 1]))::BIGINT
            FROM (SELECT DISTINCT * FROM open) o JOIN docs d ON o.shard_bytes > 1048576 AND o.depth < 60 AND lpad(bin(d.bits), 60, '0')[1:o.depth] = o.shard
        ), shards AS (SELECT DISTINCT * FROM open WHERE shard_bytes <= 1048576 OR depth = 60)
        SELECT d.doc_id, d.bytes, s.shard, s.depth, s.shard_bytes,
               CASE WHEN s.shard_bytes <= 1048576 THEN 0 ELSE coalesce(sum(d.bytes) OVER (PARTITION BY d.bits ORDER BY d.bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1048576 END::BIGINT AS page
        FROM docs d JOIN shards s ON lpad(bin(d.bits), 60, '0')[1:s.depth] = s.shard
    """,
    "op2_embedding_dedup": """
        WITH RECURSIVE fine AS (
            SELECT vec_id, label, x, sqrt(square) AS norm
            FROM (SELECT vec_id, label, x, CASE WHEN len(x) > 0 AND list_count(x) = len(x) THEN list_dot_product(x, x) END AS square
                  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings) WHERE label IS NOT NULL)
            WHERE square > 0 AND isfinite(square)
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
            WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93
        ), reach AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), found AS (
            SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
                   least(e.vec_id, (SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id))::BIGINT AS component_id
            FROM embeddings e
        )
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
    """,
    "op10_mix_sources": r"""
        WITH quality AS (
            SELECT doc_id, max(CASE WHEN quality = 0 THEN 0.25 ELSE 1.0 END)::DOUBLE AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), sized AS (
            SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   -ln((('0x' || md5('7|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, '')))[1:15])::BIGINT::DOUBLE + 0.5::DOUBLE) / (2::DOUBLE ** 60)) / greatest(coalesce(q.quality, 1), 1e-6::DOUBLE) AS key
            FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id
        ), weighed AS (
            SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source
        ), ranked AS (
            SELECT *, source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS pool, sum(weight) OVER () AS weights,
                   2::DOUBLE * coalesce(sum(source_size) OVER before, 0) AS stopped, coalesce(sum(weight) OVER before, 0) AS gone
            FROM weighed WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), levels AS (
            SELECT *, (pool - stopped) / (weights - gone) AS level, (pool - stopped) / (weights - gone) * weight > 2::DOUBLE * source_size AS stops FROM ranked
        ), targets AS (
            SELECT source, source_size, CASE WHEN stops OR last IS NULL THEN 2::DOUBLE * source_size ELSE least(2::DOUBLE * source_size, last * weight) END AS target
            FROM levels, (SELECT (SELECT level FROM levels WHERE NOT stops ORDER BY ratio, level LIMIT 1) AS last)
        ), drawn AS (
            SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken, source, epochs FROM drawn
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)
    """,
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), found AS (
            SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), counts AS (
            SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM found GROUP BY lang, source, term
        ), kept AS (
            SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term HAVING sum(df) >= 3
        ), langs AS (
            SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
        ), groups AS (
            SELECT lang, source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total
            FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts c USING (lang, source) LEFT JOIN kept k USING (lang, term) GROUP BY lang, source
        ), shares AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v)) AS p, (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)) AS q
            FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), made AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
                SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // t.p) AS value FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term GROUP BY s.lang, s.source, t.source
            ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM made
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
