"""The queries op1 to op13: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quantisation, block_pruning, huffman_files, language_id, lloyd_clusters, merge_replay, minhash_forest, packing, passages, phrase_growth, secret_scan, simhash_blocks, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op3_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantisation.search(table(spark, sf_dir, "embeddings"))


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.digests(table(spark, sf_dir, "documents"))


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out(), "lang_pred", "score")


def op9_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_files.round_trip(table(spark, sf_dir, "documents"))


def op10_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_pruning.search(table(spark, sf_dir, "embeddings"))


def op11_pigeonhole_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_blocks.near_duplicates(table(spark, sf_dir, "documents"))


def op12_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_pattern_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_growth.collocations(table(spark, sf_dir, "documents"))


def lloyd_sql(centroids: int, rounds: int) -> str:
    """A step for each round: vectors meet all centroids, then whole means by component (floor, below zero as well)."""
    steps = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, w FROM v QUALIFY k < {centroids})"""
    step = """,
a{r} AS MATERIALIZED (SELECT vec_id, v.w, k, list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
    mean = """,
m{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(w) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY 1, 2),
g{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM m{r} GROUP BY 1),
c{next} AS MATERIALIZED (SELECT k, coalesce(g.w, c.w) AS w FROM c{r} c LEFT JOIN g{r} g USING (k))"""
    text = steps.format(centroids=centroids) + "".join(step.format(r=r) + mean.format(r=r, next=r + 1) for r in range(rounds)) + step.format(r=rounds)
    return text + f"""
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (k)"""


SQL = {
    "op2_minhash_forest": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op10_block_pruning": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op13_pattern_growth": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3)) s(k)),
f AS MATERIALIZED (SELECT lang, k, g, string_split(g, ' ') AS w, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
o AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
h AS (SELECT lang, g, max(b) AS b FROM (SELECT lang, w[1] || ' ' || w[2] AS g, a AS b FROM o WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM o WHERE k = 3) GROUP BY 1, 2),
c AS (SELECT o.lang, o.g, o.a, i, array_to_string(o.w[:i], ' ') AS x, array_to_string(o.w[i + 1:], ' ') AS y FROM o LEFT JOIN h USING (lang, g), (VALUES (1), (2)) s(i) WHERE i < k AND (k = 3 OR b IS NULL OR 100 * b < 50 * o.a)),
s AS (SELECT c.lang, c.g AS phrase, c.a, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.g = x JOIN f r ON r.lang = c.lang AND r.g = y QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN t USING (lang) QUALIFY rank <= 2000""",
    "op12_lloyd_clusters": lloyd_sql(lloyd_clusters.CENTROIDS, lloyd_clusters.ROUNDS),
}


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict:
    """The others have no SQL: they are tested against brute force, round trips or held-out accuracy."""
    return dict(SQL)
