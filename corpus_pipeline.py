"""A training corpus from documents: quality, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeflow.llm import bpe, decontaminate, jaccard, pii, quality
from runeflow.llm.common import scratch_path, written
from runeflow.llm.graph import measured

#: Columns of our own beside those of the documents, whatever these are called.
_SIG, _ID, _OF = "__pipeline_sig", "__pipeline_id", "__pipeline_of"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones, accepts.

    A null text is scored as the empty one; repeated rows are kept or left together; an empty table gives an empty one.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least id, of each group of texts whose 5-word sets are alike by 0.8 or more.

    Rows without words or without id are in no group and stay. Where an id stands on several texts, each text counts by
    itself. An empty table gives an empty one.
    """
    found = jaccard.jaccard_groups(docs)
    groups = written(found.select("doc_id", "sig", "kept"), "groups")
    repeated = written(groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    gone = written(groups.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    if not repeated.limit(1).count():
        return docs.join(measured(gone), "doc_id", "left_anti").select(*docs.columns)
    some = measured(repeated)
    out = docs.join(measured(gone), "doc_id", "left_anti").join(some, "doc_id", "left_anti").select(*docs.columns)
    texts = jaccard.append_signature(docs.join(some, "doc_id", "left_semi").select(*docs.columns), _SIG)
    standing = groups.where("kept AND sig IS NOT NULL").join(some, "doc_id", "left_semi").select(F.col("doc_id").alias(_ID), F.col("sig").alias(_OF))
    once = texts.join(standing, (F.col("doc_id") == F.col(_ID)) & (F.col(_SIG) == F.col(_OF)), "left_semi").dropDuplicates(["doc_id", _SIG])
    return out.unionByName(once.select(*docs.columns)).unionByName(texts.where(F.col(_SIG).isNull()).select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Null and empty texts hold none; rows without id are told apart by a number;
    all rows of an id go if one has an item; an empty table, or an empty benchmark, leaves all as it is.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    space = decontaminate.fit(docs)
    leaky = written(decontaminate.find_leaks(docs, items, space=space).select("doc_id").distinct(), "leaky")
    out = docs.join(measured(leaky), "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.where(F.col("doc_id").isNull())
    if not nameless.limit(1).count():
        return out
    numbered = written(nameless.withColumn(_ID, F.monotonically_increasing_id()), "nameless")
    bad = written(decontaminate.find_leaks(numbered, items, id_col=_ID, space=space).select(F.col("doc_id").alias(_ID)).distinct(), "leaky")
    clean = numbered.join(measured(bad), _ID, "left_anti").select(*docs.columns)
    return out.where(F.col("doc_id").isNotNull()).unionByName(clean)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text. Null texts stay null, and no row goes."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and n_tokens of each text, whose ids are decoded again; decoded_ok tells that they give the text.

    Null and empty texts have no ids; repeated rows each give a row; an empty table gives an empty one.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.bpe_round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    same = F.decode("decoded", "utf-8") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("decoded_ok"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
