"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embeddings, licenses, merkle, minhash, mixing, packing, quality_model, quality_rules, sharding, suffixes, tokens, url_filters


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: two-word shingles, similarity 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    return sharding.shard(_table(spark, sf_dir, "documents"), 16)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, with the longest prefix that fits 2048 tokens."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text licences and licence notices of all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model of the labelled ones."""
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and adaptive verdicts of all documents."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings within their labels: cosine 0.98."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and link-graph verdicts of all pages."""
    return url_filters.verdicts(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents to source weights takes of each."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all damaged conversations."""
    return conversations.repaired(_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents, verified after some texts were altered."""
    return merkle.verified(_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes leave of all documents."""
    return suffixes.digests(suffixes.deduplicated(_table(spark, sf_dir, "documents"), 100))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_quality_model": op5_quality_model,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash.SQL,
    "op4_license_scan": licenses.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_embedding_dedup": embeddings.SQL,
    "op9_url_filters": url_filters.SQL,
    "op10_mixing": mixing.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
