"""Registered queries of the training-data operators: thin, over whole tables, production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bpe import bpe_decode, bpe_encode
from weftgraph.llm.common import shared_dir, table
from weftgraph.llm.decontaminate import contaminated
from weftgraph.llm.exact_dedup import exact_groups
from weftgraph.llm.language import fit_languages, fold, identify
from weftgraph.llm.pii import KINDS, find_pii, of_kind, span_text
from weftgraph.llm.sharding import pack_shards
from weftgraph.llm.simhash import near_groups
from weftgraph.llm.token_counts import token_totals
from weftgraph.llm.token_files import ids_crc32, read_tokens, write_tokens
from weftgraph.llm.url_filter import Rule, filter_urls

BYTE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
END_ID = 2
SHARDS = 40
TOKEN_LIMIT = 4096
#: The explicit URL rules (fixed values).
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def id_text(ids: str) -> F.Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe_encode(docs, path, keep=["doc_id"])
    return bpe_decode(encoded, path, keep=["doc_id", "ids"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(id_text("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_TOKENIZER), END_ID)
    return ids_crc32(read_tokens(spark, path), ["doc_id", "start", "n_tokens"])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_pii(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *counts, F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans")
    )


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_totals(sized, public_tokenizers.path(PIECE_MODEL), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id")) == 0)
    model = fit_languages(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_url_templates": op3_url_templates,
        "op4_token_files": op4_token_files,
        "op5_pii": op5_pii,
        "op6_vector_packing": op6_vector_packing,
        "op7_token_counts": op7_token_counts,
        "op8_language": op8_language,
        "op9_simhash": op9_simhash,
        "op10_decontaminate": op10_decontaminate,
    }
