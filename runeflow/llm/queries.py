"""The queries of the subpackage by name, over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, jaccard, pii, quality, secrets_scan, token_counts, token_files, twins, vectors

QUERIES: dict = {}
ORACLE: dict = {"op1_html": twins.HTML, "op7_vector_join": twins.VECTORS, "op9_jaccard_join": twins.JACCARD}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and the round trip."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_digests(docs, path, public_tokenizers.PATTERN, carry=["doc_id"])


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to seekable shard files and read back from them."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), token_files.scratch_folder(spark))
    return token_files.read_token_digests(manifest)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    return pii.find_pii(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets_scan.find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model that never sees the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, carry=["doc_id"])
    return scored.select("doc_id", (quality.fold() == 2).alias("held_out"), "score", "predicted")


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word sets are alike by 0.8 or more."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings whose cosine is 0.95 or more."""
    return vectors.vector_groups(table(spark, sf_dir, "embeddings"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))
