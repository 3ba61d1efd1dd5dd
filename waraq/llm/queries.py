"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waraq.llm import alignment, centroids, decontaminate, exact_dedup, html_extract, language_id, minhash, packing, quality, secrets, sharding, simhash, toxicity
from waraq.runtime import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_simhash, op3_quality, op4_secrets, op5_html_extract, op6_decontaminate, op7_toxicity, op8_exact_dedup, op9_packing, op10_language_id, op11_centroids, op12_alignment, op13_minhash)
}

def _clustering_sql(clusters: int = 40, rounds: int = 5) -> str:
    """k-means by whole distances to all centroids, round by round."""
    parts = [
        """kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w
            FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
        )""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY rank, w) - 1 AS cluster, w
            FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS rank, w FROM kept ORDER BY rank, w LIMIT {clusters})
        )""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
            SELECT row, min(d * {clusters} + cluster) % {clusters} AS cluster, min(d) AS distance
            FROM (SELECT v.row, c.cluster, CAST(list_sum(list_transform(list_zip(v.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept v, c{r} c)
            GROUP BY row
        )""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT c.cluster, coalesce(m.w, c.w) AS w FROM c{r} c LEFT JOIN (
                    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS w
                    FROM (SELECT a.cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                          FROM a{r} a JOIN (SELECT row, unnest(w) AS x, generate_subscripts(w, 1) AS dim FROM kept) USING (row) GROUP BY a.cluster, dim)
                    GROUP BY cluster
                ) m USING (cluster)
            )""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (row) JOIN c{rounds} c ON a.cluster = c.cluster"""


ORACLE = {
    "op11_centroids": _clustering_sql(),
    "op13_minhash": r"""
        WITH RECURSIVE worded AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id,
                   list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS MATERIALIZED (
            SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM worded
        ), elements AS MATERIALIZED (SELECT row, unnest(s) AS e FROM sets),
        links AS MATERIALIZED (
            SELECT a, b FROM (SELECT x.row AS a, y.row AS b, count(*) AS common FROM elements x JOIN elements y ON x.e = y.e AND x.row <> y.row GROUP BY x.row, y.row)
            JOIN sets p ON p.row = a JOIN sets q ON q.row = b WHERE 100 * common >= 85 * (len(p.s) + len(q.s) - common)
        ), reach AS (SELECT row AS a, row AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        lowest AS (SELECT r.a AS row, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.row = r.b GROUP BY r.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (row)
    """,
    "op8_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM hashed
    """,
}
