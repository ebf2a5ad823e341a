"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, langid, licenses, manifest, media, mixing, secrets, suffixdedup, toxicity
from .common import table
from .embeddings import near_duplicate_vectors
from .packing import pack_documents
from .simhash import near_duplicates
from .tokenbin import read_tokens, write_tokens

#: Tokenizers of the queries: file, what it does with spaces, end id.
BYTES = (public_tokenizers.path("byte_bpe_50k.json"), "led", 2)
WORDS = (public_tokenizers.path("word_bpe_49k.json"), "dropped", 1)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = write_tokens(table(spark, sf_dir, "documents"), *BYTES)
    return read_tokens(spark, folder, shards).drop("shard")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *WORDS, capacity=4096)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(suffixdedup.mark_repeats(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.with_media(table(spark, sf_dir, "documents")))


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.pieces(table(spark, sf_dir, "documents")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(langid.learnable(docs)))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_mix_sources": op2_mix_sources,
    "op3_secrets": op3_secrets,
    "op4_simhash": op4_simhash,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_media_avi": op9_media_avi,
    "op10_embedding_near_dup": op10_embedding_near_dup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op2_mix_sources": mixing.ORACLE, "op8_license_scan": licenses.oracle(), "op11_merkle_manifest": manifest.oracle(), "op12_fill_in_middle": fim.oracle()}
