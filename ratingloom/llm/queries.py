"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import (
    fill_middle,
    html_text,
    language_id,
    language_model,
    mixing,
    ngram_join,
    packing,
    quality,
    search,
    segmentation,
    simhash,
    warc,
    zone_clusters,
)
from ratingloom.llm.common import fold, table
from ratingloom.session import fresh_path, write_shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_sentencepiece(spark, sf_dir):
    return segmentation.sample_segmentations(table(spark, sf_dir, "documents"))


@query
def op1_sentencepiece_decode(spark, sf_dir):
    """The texts that the ids of every segmentation decode to."""
    return segmentation.decode(op1_sentencepiece(spark, sf_dir)).select("doc_id", "rank", "n_pieces", "decoded")


@query
def op2_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = (fold(F.col("doc_id"), 5) == 1).alias("held_out")
    return language_model.score(docs.select("doc_id", "text", held_out))


@query
def op3_warc(spark, sf_dir):
    path = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.read_archive(spark, path)).drop("intact")


ORACLE["op3_warc"] = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), r AS (
    SELECT *, CASE WHEN payload_bytes >= 1000
                   THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS response
    FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM r
"""


@query
def op4_top_k_search(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op4_top_k_search"] = """
WITH v AS (
    SELECT DISTINCT vec_id,
           list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = write_shared(docs.select("doc_id", quality.statistics(F.col("text")).alias("s")), "quality")
    kept, _ = quality.judge(rated, table(spark, sf_dir, "labels"))
    columns = [F.col(f"s.{name}") for name in quality.STATISTICS]
    return rated.select("doc_id", *columns, quality.base_failed(F.col("s")).alias("base_failed"), kept.alias("kept"))


@query
def op6_mixing(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


# the rates of a source are all alike at the solution, its share of the target
ORACLE["op6_mixing"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS late
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM d GROUP BY source
), capped AS (
    SELECT sum(2.0 * source_size) OVER w AS used, sum(weight) OVER w AS gone
    FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)
    UNION ALL SELECT 0.0, 0
), level AS (
    SELECT max((1.5 * (SELECT sum(source_size) FROM s) - used) / ((SELECT sum(weight) FROM s) - gone)) AS level
    FROM capped WHERE gone < (SELECT sum(weight) FROM s)
), t AS (
    SELECT source, source_size, CAST(least(2.0 * source_size, weight * level) AS DOUBLE) AS target FROM s, level
), r AS (
    SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           CASE WHEN abs(rate - round(rate)) < 1e-6 THEN round(rate) ELSE rate END AS near,
           CAST(floor(near) AS BIGINT) AS whole
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
    SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS need,
           sum(size) OVER (PARTITION BY source ORDER BY late, doc_id, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS so_far
    FROM r
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + CASE WHEN near > whole THEN greatest(0, least(size, need - so_far)) ELSE 0 END AS BIGINT)
           AS taken
FROM o
"""


@query
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark, sf_dir):
    found = language_id.language_of_documents(table(spark, sf_dir, "documents"))
    return found.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


@query
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query
def op11_zone_clusters(spark, sf_dir):
    return zone_clusters.cluster(table(spark, sf_dir, "embeddings"))


def _cluster_sql(rounds: int, k: int, dim: int) -> str:
    """The rounds one after the other; c0, c1, ... are the centroids before each."""
    steps = [
        f"""v AS (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
    FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (
    SELECT r, vec_id, v, cluster,
           list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
    FROM v, c{i}
), a{i} AS (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (distance, cluster)) AS cluster,
           min(distance) AS distance
    FROM d{i} GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
    SELECT cluster, j, sum(x) AS s, count(*) AS n
    FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS j FROM a{i}) GROUP BY cluster, j
), c{i + 1} AS (
    SELECT c.cluster, coalesce(m.c, c.c) AS c
    FROM c{i} c LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM m{i} GROUP BY cluster
    ) m ON m.cluster = c.cluster
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, a.cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
"""


ORACLE["op11_zone_clusters"] = _cluster_sql(5, 40, 64)


@query
def op12_fill_middle(spark, sf_dir):
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


ORACLE["op12_fill_middle"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, len(u) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM documents
), p AS (
    SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix,
           array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
           array_to_string(u[greatest(x, y) + 1:], '') AS suffix
    FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query
def op13_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


# every pair that shares an n-gram, counted n-gram by n-gram
ORACLE["op13_ngram_join"] = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x20\x09-\x0D]+') AS w
    FROM documents
), g AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS g
    FROM d
), x AS (
    SELECT r, unnest(g) AS g FROM g
), o AS (
    SELECT a.r AS a, b.r AS b, count(*) AS met FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), h AS (
    SELECT a, b FROM o JOIN g ga ON ga.r = a JOIN g gb ON gb.r = b
    WHERE 100 * met >= 80 * (len(ga.g) + len(gb.g) - met)
), l AS (
    SELECT a, b FROM h UNION ALL SELECT b, a FROM h
), c(a, b) AS (
    SELECT r, r FROM d UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b
), m AS (
    SELECT a, min(doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY a
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM g JOIN m ON m.a = g.r
"""
