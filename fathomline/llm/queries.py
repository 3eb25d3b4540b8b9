"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, exact_dedup, langid, quality, records, secrets, sentencepieces, sharding, simhash, style_tree
from fathomline.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), model, path_col="source")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.encoded_index(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", end=True, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def remainder(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trees = langid.learn(documents.where(remainder(5) != 0))
    return langid.predict(documents, trees).withColumn("held_out", remainder(5) == 0).select("doc_id", "held_out", "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"), count=40)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def quality_field(spark: SparkSession, documents: DataFrame, sf_dir: str) -> quality.Field:
    """The field that op8 and the pipeline score with, learnt from the labels outside the held-out fold."""
    return quality.learn(documents, table(spark, sf_dir, "labels").where(remainder(4) != 2))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = quality.scores(documents, quality_field(spark, documents, sf_dir), threshold=0.7)
    return out.withColumn("held_out", remainder(4) == 2).select("doc_id", "held_out", "score", "predicted")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = style_tree.main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select("page_id", "url", "text", "n_chars")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_token_records": op3_token_records,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_main_text": op9_main_text,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op2_decontamination": r"""
        WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE text IS NOT NULL),
        k AS (SELECT item_id, w, least(5, len(w)) AS k FROM w WHERE len(w) > 0),
        items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
        sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
        docs AS (
            SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
        ),
        hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (k, s) GROUP BY 1, 2)
        SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
        FROM hits JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
