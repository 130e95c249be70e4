"""The llm queries and their SQL: ``queries()`` and ``oracle_sql()``, as the root entry module adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .probminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_crf")


def op3_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .isomedia import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfair import mix_places

    return mix_places(table(spark, sf_dir, "documents"))


def op5_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sorted_passes import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zstd_quality import FOLDS, THRESHOLD, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest_columns, find_pii

    return digest_columns(find_pii(table(spark, sf_dir, "documents")))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract

    pages = table(spark, sf_dir, "pages")
    return extract(pages.select(F.struct("page_id", "url").alias("key"), "html"), "key").select("key.page_id", "key.url", "text", "n_chars")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    told = encode_decode(table(spark, sf_dir, "documents"), vocabulary())
    return told.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_templates import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_dropped", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_prob_minhash, op2_secret_scan, op3_iso_media, op4_pfair_mix, op5_sorted_passes, op6_zstd_quality, op7_personal_data, op8_main_text, op9_byte_bpe, op10_line_templates)}


def oracle_sql() -> dict[str, str]:
    from . import line_templates

    return {"op10_line_templates": line_templates.ORACLE_SQL}
