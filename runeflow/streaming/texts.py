"""Structured Streaming over folders of documents: the same stateless expressions as in batch, and a dead-letter split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runeflow.operators import text as ops


def document_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def profile(docs: DataFrame) -> DataFrame:
    """Scalars, bytes, paragraphs and state of each text; the same in batch and in a stream, without any state."""
    n, size = ops.scalar_counts(F.col("text"))
    return docs.select("doc_id", n.alias("n_scalars"), size.alias("n_bytes"), F.size(ops.paragraphs(F.col("text"))).alias("n_paragraphs"), ops.validity(F.encode("text", "utf-8")).alias("status"))


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str, late: str) -> DataFrame:
    """Counts of keys in tumbling windows, with rows up to ``late`` behind the latest still counted."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n"))


def run_once(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, appended to a parquet folder, then the stream ends."""
    frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
