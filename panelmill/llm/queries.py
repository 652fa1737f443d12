"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelmill.llm import chat, licenses, media, mixing, neighbours, ngram_join, packing, quality, sharding, suffix_dedup
from panelmill.llm.tokens import tokenizer_path

#: Shards of the production table.
SHARDS = [f"shard-{i:03d}" for i in range(64)]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op8_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    planted = spark.createDataFrame(chat.PLANTED, rows.schema)
    return chat.format_chats(rows.unionByName(planted))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package, and counted with it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_media_columns, op3_best_fit_packing, op4_license_scans, op5_embedding_near_dedup, op6_ngram_jaccard_join, op7_sharding,
                            op8_mixing_targets, op9_suffix_array_dedup, op10_chat_formatting, pipeline)}


def oracle() -> dict[str, str]:
    slots = ",".join(map(str, sharding.fill_table(SHARDS)))
    return {
        "op7_sharding": f"""
            WITH t AS (SELECT generate_subscripts(v, 1) - 1 AS slot, unnest(v)::INTEGER AS shard FROM (SELECT string_split('{slots}', ',') AS v))
            SELECT d.doc_id, t.slot::BIGINT AS slot, t.shard
            FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents) d
            JOIN t USING (slot)""",
        "op8_mixing_targets": r"""
            WITH s AS (SELECT doc_id, source, md5(coalesce(text, '')) AS body, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
            g AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s GROUP BY source),
            w AS (SELECT *, (sid % 3 + 1)::BIGINT AS weight FROM g),
            b AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER lean, 0) AS left_size,
                    sum(weight) OVER () - coalesce(sum(weight) OVER lean, 0) AS left_weight
                  FROM w WINDOW lean AS (ORDER BY source_size::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            c AS (SELECT *, min(CASE WHEN 3.0::DOUBLE * source_size::DOUBLE * left_weight::DOUBLE <= weight::DOUBLE * left_size::DOUBLE THEN 1 ELSE 0 END)
                    OVER (ORDER BY source_size::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "full" FROM b),
            t AS (SELECT source, sid, source_size, CASE WHEN "full" = 1 THEN (3 * source_size)::DOUBLE
                    ELSE (weight * (sum(source_size) OVER () - 3 * sum(source_size * "full") OVER ()))::DOUBLE
                         / (sum(weight * (1 - "full")) OVER ())::DOUBLE END AS target FROM c),
            k AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS budget FROM t),
            r AS (SELECT s.doc_id, s.size, k.source_size, k.target, k.budget, k.sid, md5('mix:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.body) AS hash,
                    CASE WHEN k.source_size = 0 THEN 0 ELSE k.budget // k.source_size END AS epochs
                  FROM s JOIN k ON s.source IS NOT DISTINCT FROM k.source)
            SELECT doc_id, size, source_size, target,
              (epochs * size + greatest(0, least(size, budget - epochs * source_size
                 - coalesce(sum(size) OVER (PARTITION BY sid ORDER BY hash, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
            FROM r""",
    }
