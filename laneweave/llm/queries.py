"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contamination import find_contamination, hit_words
from .language import fit, held_out, predict
from .divergence import source_divergence
from .minhash import near_set_groups
from .negatives import hard_negatives
from .oracles import ORACLES  # noqa: F401
from .packing import pack_documents
from .simhash import near_duplicate_groups, with_fingerprint
from .shared import written
from .sstable import crc32_of_ids, read_tokens, write_tokens
from .substring import remove_repeated_passages
from .suffix import remove_repeated_bytes

from .topk import top_k
from .urls import judge_urls
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = written(with_fingerprint(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]), "marks")
    groups = near_duplicate_groups(marks)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), respace=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file: LANEWEAVE_TOKENIZERS, else the installed folder."""
    folder = os.environ.get("LANEWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", crc32_of_ids().alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).drop("ids")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = hit_words()
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    # A seventh of the labels is wrong on purpose.
    moved = F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_set_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_shards": op3_token_shards,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_exact_topk": op6_exact_topk,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_minhash_dedup": op13_minhash_dedup,
}
