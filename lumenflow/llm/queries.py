"""The contract's queries over the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprint, language_id, line_dedup, lm_score, mixing, near_dedup, packing, pii, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.train_language_id(docs, learn=language_id.not_held_out())
    held_out = F.coalesce(language_id.fold() == 1, F.lit(False)).alias("held_out")
    return language_id.identify(docs.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_documents(spark, sf_dir), digest=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_documents(spark, sf_dir))
    secrets = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = (F.size("all_spans") + F.size("secrets")).cast("long").alias("n_found")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("all_spans").alias("spans"), secrets.alias("secrets"), found)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_lm_score, op3_mixing, op4_line_dedup, op5_url_filter, op6_exact_dedup, op7_packing, op8_fingerprint, op9_pii, op10_near_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op5_url_filter": url_filter.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE}
