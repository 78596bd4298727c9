"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and its rows are the next one's docs.

toxicity: documents that the classifier rejects go (learned from labels outside the held-out fold);
near_duplicates: one document, that with the smallest doc_id, of each component of five-word
shingles with a similarity of 0.8 or more stays; secrets: found spans are replaced by [SECRET];
mixing: sources are brought to their target weights, documents repeated or cut accordingly;
encoding: token ids of every document. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aggrolens.llm import bpe, common, jaccard_join, mixing, secrets, toxicity
from aggrolens.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that with the smallest doc_id, null ones last, and of rows that share it one. Documents without words all stay.

    Rows are told apart by a key of their own, as doc_ids can be null or occur with several texts.
    """
    row = "_row" + "_" * max(map(len, docs.columns))  # no column of docs
    rows = common.saved(docs.withColumn(row, F.monotonically_increasing_id()))
    ids = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("doc_id"), "text")
    found = jaccard_join.similar_documents(ids, size=5, percent=80)
    gone = common.saved(found.where("n_shingles > 0 and doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(row)))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, and sets n_chars anew."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows: whole passes over documents and runs of their words. Documents without words take no part."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Compression distances, similarity joins and byte-pair encoding have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
