"""The numbered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, jaccard_join, mixing, prefix_trie, quality, repeats, secrets, sharding, toxicity, warc, whitening

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("passes", "parts")


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_source_mixing, op2_warc_segments, op3_secret_scan, op4_compression_toxicity, op5_repeated_strings, op6_jaccard_components, op7_embedding_near_dedup, op8_histogram_sharding, op9_curve_neighbours, op10_bpe_codec, op11_whitening, op12_additive_quality, op13_prefix_trie)
}
ORACLE_SQL: dict[str, str] = {}
