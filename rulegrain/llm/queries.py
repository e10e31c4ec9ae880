"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain.llm import chat, decontam, html_text, knn, linededup, minhash, mixing, quality, sharding, toxicity
from rulegrain.llm.common import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.verdict(decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    return judged.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return knn.topk(vectors, F.col("id") % knn.EVERY == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_deleted", "deleted")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(read_table(spark, sf_dir, "conversations"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(read_table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_sharding, op2_quality, op3_decontamination, op4_mixing, op5_topk, op6_line_dedup, op7_chat, op8_html, op9_toxicity, op10_minhash)}


#: DuckDB SQL of those that SQL can express at that size; the others are tested against brute force.
ORACLE_SQL = {
    "op5_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE CAST(list_inner_product(q.e, c.e) AS BIGINT) END AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op7_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<||') AS body FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
        s AS (
            SELECT conv_id, perspective, turn, role, role = perspective AS trained, body,
                   CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
                        ELSE '<|im_start|>user name=' || regexp_replace(replace(role, '<|', '<||'), '[\r\n]+', ' ', 'g') || chr(10) END AS head
            FROM t JOIN p USING (conv_id)
        ), w AS (
            SELECT *, head || body || '<|im_end|>' || chr(10) AS segment,
                   row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, body) - 1 AS seq,
                   CAST(sum(length(head || body) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
            FROM s
        )
        SELECT conv_id, perspective, seq, turn, role, segment, CAST(char_end - length(segment) AS BIGINT) AS char_start, char_end, trained,
               CASE WHEN trained THEN CAST(char_end - length(segment) + length(head) AS BIGINT) END AS loss_start, CASE WHEN trained THEN char_end - 1 END AS loss_end
        FROM w
    """,
}
